"""Decontamination, licences, language, quality, counts, sharding against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factsieve.llm import decontam, encoder, language, license_rules, licenses, packing, quality, sharding, token_counts

LETTERS = str.maketrans("0123456789", "ghijklmnop")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(text, items):
    words, hit, names = plain(text), set(), set()
    for item, item_text in items:
        own = plain(item_text)
        m = min(10, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                names.add(item)
    listed = sorted(str(n) for n in names if n is not None)
    return len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, odd, none, limit):
    rng = random.Random(1)
    vocabulary = ["a", "bb", "The", "é", "x1", "zz"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(n)) for k, n in enumerate([30, 12, 10, 9, 2, 1, 0, 25])] + [(20, None), (None, "Lazy dog"), (3, "zz é é bb"), (11, "x-x")]
    texts = [make(rng.choice([0, 1, 5, 40, 200])) for _ in range(60)] + [items[0][1], "q " + items[7][1] + " q", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in decontam.contamination(docs, bench, limit=limit).collect()]
    want = [(r["doc_id"], *brute_contamination(r["text"], items)) for r in docs.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    left = decontam.clean(odd, bench, limit=limit)
    assert left.columns == odd.columns
    assert left.count() == sum(not brute_contamination(r["text"], items)[-1] for r in odd.collect())
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


def brute_licences(text):
    words = plain(text)
    joined = " " + " ".join(words) + " "
    base = [(label, i) for phrase, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    found = []
    for order, rule in enumerate(license_rules.rules()):
        found += [(rule.priority, m.start(), m.end(), order, rule) for m in re.finditer(rule.pattern, joined)]

    def beaten(d):
        return any(
            e[1] <= d[1] and e[2] >= d[2] and (e[0], -(e[2] - e[1]), e[3]) < (d[0], -(d[2] - d[1]), d[3]) for e in found
        )

    kept = [d for d in found if not beaten(d)]
    names = sorted({label for label, _ in base})
    score = 1.0 if base else max((d[4].confidence for d in kept), default=0.0)
    places = [i for _, i in base]
    labels = sorted({d[4].label for d in kept} | set(names))
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(names), ",".join(labels), score


NOTICES = [
    "Released under the MIT License. Then under the mit license under the MIT license.",
    "Licensed under the Apache License, Version 2.0; see https://www.apache.org/licenses/LICENSE-2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc CC BY NC cc by nc sa 4.0 cc by 4.0 apache license version 2 0 apache license version 2",
    "SPDX-License-Identifier: GPL-2.0-or-later. All rights reserved. It is in the public domain.",
    "Subject to the terms of the Mozilla Public License v2.0, the BSD 3-Clause License or the ISC licence.",
    "BSD license; new BSD; wtfpl; dual licensed under the zlib license and the unlicense; Kernel MIT No Attribution",
]


def test_licences_equal_brute_force(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate([*NOTICES, " ".join(NOTICES * 3)], 100)), "doc_id long, text string")
    docs = docs.unionByName(odd.select("doc_id", "text"))
    found = [tuple(r)[:8] for r in licenses.scan(docs).collect()]
    want = [(r["doc_id"], *brute_licences(r["text"])) for r in docs.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert licenses.scan(none).count() == 0


def test_licence_scan_runs_no_python(odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def samples(pattern):
    """Wordings that a rule's pattern matches: each alternative of each choice, the others as they come first."""
    import re._parser as parser

    def walk(tree, pick):
        out = ""
        for kind, value in tree:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "NOT_LITERAL":
                out += "q"
            elif kind == "IN":
                first = value[0]
                out += "q" if str(first[0]) == "NEGATE" else chr(first[1][0] if str(first[0]) == "RANGE" else first[1])
            elif kind == "BRANCH":
                out += walk(value[1][pick % len(value[1])], pick)
            elif kind == "SUBPATTERN":
                out += walk(value[3], pick)
            elif kind == "MAX_REPEAT":
                low, high, inner = value
                out += walk(inner, pick) * (low if pick % 2 else min(high, max(low, 1)))
            elif kind != "ASSERT":
                raise ValueError(kind)
        return out

    tree = parser.parse(pattern)
    return {walk(tree, pick) for pick in range(24)}


def test_rules_are_many_and_pass_both_filters():
    """Every wording of every rule holds a stem, a keyword of its group, and is matched by the rule."""
    signatures = license_rules.groups()
    assert len(license_rules.TEXTS) > 70 and len(license_rules.rules()) > 500
    assert {label for _, label in license_rules.BASE} <= {r.label for r in license_rules.rules()}
    assert all(0 <= r.priority < licenses.PRIORITIES for r in license_rules.rules())
    for group in signatures:
        assert all(len(k.strip()) > 2 and k.strip() not in ("the", "under", "to the") for k in group.keywords), group.keywords
        for rule in group.rules:
            for sample in samples(rule.pattern):
                text = f"{sample.rstrip()} "
                assert re.search(rule.pattern, text), (rule, sample)
                assert any(k in text for k in group.keywords), (group.keywords, text)
                assert any(s in text for s in licenses.STEMS), text


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the
above copyright notice. 3. Neither the name of the University nor the names of its contributors may be used to endorse or
promote products derived from this software."""
LICENCE_TEXTS = [
    (MIT, "mit"),
    (BSD, "bsd,bsd-3-clause"),
    ("You may not use this file except in compliance with the License.", "apache-2"),
    ("GNU Lesser General Public License version 2.1 or later", "lgpl-2.1+"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
     "License, or (at your option) any later version.", "gpl-2.0+"),
    ("This code is not licensed under the GPL version 2", "not-gpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("the council approved a new bridge under the terms of the old contract", ""),
]


@pytest.mark.parametrize("text, labels", LICENCE_TEXTS)
def test_licence_texts_are_named(spark, text, labels):
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(labels.split(",")) <= set(found["labels"].split(",")), found["labels"]
    assert bool(labels) == (found["score"] > 0)
    if labels.startswith("not-"):
        assert found["labels"] == found["labels"] and "gpl-2.0" not in found["labels"].split(",")


def test_many_notices_in_one_text_take_linear_time(spark):
    import time

    def seconds(n):
        text = "released under the mit license and gpl version 2 " * n
        start = time.perf_counter()
        row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row["n_base"] == n and row["last_word"] == 9 * (n - 1) + 1 and len(row["detections"]) == 2 * n
        return time.perf_counter() - start

    seconds(10)
    assert seconds(2000) < 10


def brute_table(shards, slots):
    import xxhash

    names = sorted(shards)
    orders = []
    for s in names:
        offset, skip = xxhash.xxh64_intdigest(s, 1) % slots, xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1
        orders.append(iter([(offset + k * skip) % slots for k in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for s, order in zip(names, orders):
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = s
    return [shards.index(owner[k]) for k in range(slots)]


def test_lookup_table(spark, odd, none, tmp_path):
    shards = ["c", "a", "b", "d", "e"]
    assert sharding.lookup_table(shards, 101) == brute_table(shards, 101)
    table = sharding.lookup_table(shards)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    names = [shards[k] for k in table]
    fewer = sharding.lookup_table(shards[:-1])
    moved = sum(a != "e" and a != shards[k] for a, k in zip(names, fewer))
    assert moved < 0.15 * len(table)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)
    rows = sharding.place(odd, shards).collect()
    assert len(rows) == odd.count() and all(r["shard"] == names[r["slot"]] for r in rows)
    assert sharding.place(none, shards).count() == 0
    sharding.write(odd, shards, str(tmp_path / "out"), rows_per_file=2)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == odd.count() and set(odd.columns) < set(again.columns)


def unpack(rows, docs, coder, window=4096):
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append(coder.encode(text) + (2).to_bytes(4, "little"))
    return ids


def test_packing_round_trip(spark, odd, none, folder, tokenizer):
    coder = encoder.Encoder(tokenizer)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text")
    )
    check_packing(docs, packing.pack(docs, tokenizer).collect(), coder.whole)
    assert packing.pack(none, tokenizer).count() == 0
    assert packing.pack(odd, tokenizer).count() >= odd.count()


def check_packing(docs, rows, encode, window=4096, padding=0.03):
    """Every id lies in exactly one piece, checksums are those of the ids, and sequences have no gaps."""
    whole = Counter()
    for r in docs.collect():
        whole[r["doc_id"], encode(r["text"] or "") + (2).to_bytes(4, "little")] += 1
    found = Counter()
    for doc_id, data in whole:
        found[doc_id, len(data) // 4] += whole[doc_id, data]
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == found.keys()
    for key, parts in pieces.items():
        same = [data for doc_id, data in whole if (doc_id, len(data) // 4) == key for _ in range(whole[doc_id, data])]
        left = Counter(parts)
        for data in same:  # rows of equal id and length may be cut in different places
            at = 0
            while at < len(data) // 4:
                step = next(p for p in left if p[0] == at and zlib.crc32(data[4 * at : 4 * (at + p[1])]) == p[2])
                left[step] -= 1
                left += Counter()
                at += step[1]
            assert at == len(data) // 4
        assert not left
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    full = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        full += at
    assert full >= (1 - padding) * window * (len(sequences) - 1)


def test_long_rests_are_cut_to_fill_sequences(spark, tokenizer):
    """Rests of over half a window: no two fit together, yet little padding is left."""
    coder, rng = encoder.Encoder(tokenizer), random.Random(8)
    rows = [(k // 2, " ".join(rng.choice(["alpha", "beta", "of", "the", "zq", "7"]) for _ in range(rng.randint(2100, 3900)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = packing.pack(docs, tokenizer).collect()
    check_packing(docs, found, coder.encode, padding=0.01)
    assert len(found) > len(rows)


def test_checksums_of_the_parts_of_a_cut():
    import numpy as np

    rng = random.Random(4)
    for size in (8, 9, 16, 100, 4095):
        ids = bytes(rng.randrange(256) for _ in range(4 * size))
        marks = np.frombuffer(packing.prefix_crcs(ids), np.uint32)
        assert len(marks) == (size - 1) // packing.CUT
        for k, mark in enumerate(marks, 1):
            cut = 4 * packing.CUT * k
            assert mark == zlib.crc32(ids[:cut])
            end = packing.crc_of_rest(np.array([zlib.crc32(ids)]), np.array([mark]), np.array([len(ids) - cut]))
            assert end[0] == zlib.crc32(ids[cut:])


HISTOGRAMS = {
    "over half a window": lambda r: r.randint(2100, 4095),
    "just over a third": lambda r: r.randint(1400, 1900),
    "short": lambda r: r.randint(1, 200),
    "one long length": lambda r: 2731,
    "nearly whole": lambda r: r.choice([4088, 4095, 3000]),
    "mixed": lambda r: r.choice([r.randint(1, 4095), r.randint(1, 300), 1000]),
}


@pytest.mark.parametrize("histogram, shortest", [*((h, 256) for h in HISTOGRAMS), ("mixed", 16), ("mixed", 5000)])
def test_layout_uses_every_place_once_with_little_padding(histogram, shortest):
    import numpy as np

    rng = random.Random(2)
    counts = Counter(HISTOGRAMS[histogram](rng) for _ in range(3000))
    plan = packing.layout(counts, shortest=shortest)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, first = packing.placed(plan, length, rank, 4096)
    fill = Counter()
    for s, a, n in zip(sequence.tolist(), first.tolist(), length.tolist()):
        fill[s] += a
        if a < n:
            assert a % packing.CUT == 0
            fill[s + 1] += n - a
    assert max(fill.values()) <= 4096 and sum(fill.values()) == length.sum()
    assert sum(fill.values()) >= 0.985 * 4096 * (max(fill) + 1), sum(fill.values()) / 4096 / (max(fill) + 1)


def test_least_squares_meets_its_conditions():
    import numpy as np

    rng = np.random.default_rng(1)
    matrix, target = rng.random((12, 30)), rng.random(12) * 10
    x = packing.least_squares(matrix, target)
    gain = matrix.T @ (target - matrix @ x)
    assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max() < 1e-6


def test_languages_of_a_batch_take_the_memory_of_one_text():
    texts = [None, ""] + [f"{k} the cat sat on the mat and le chat est sur la table " * 400 for k in range(200)]
    column = pa.array(texts, pa.string())
    answers = language.judge_all({"en": b"the cat sat on the mat " * 50, "fr": b"le chat est sur la table " * 50})
    one = [answers(pa.array([text], pa.string()))[0] for text in texts]
    tracemalloc.start()
    try:
        assert answers(column) == one
        assert tracemalloc.get_traced_memory()[1] < column.nbytes / 4
    finally:
        tracemalloc.stop()
