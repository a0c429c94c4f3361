"""Licence scan with ordered signature rules, in DataFrame functions only.

A text becomes lower-case words (A-Z only) joined by single blanks. A first filter looks for any
word stem of licence notices; texts without one are done. In the others the rules of each group
of which a keyword occurs are matched everywhere. A detection is an interval of characters. One
that lies within an interval of a rule with a lower priority number, or of a longer or earlier one
of equal priority, is suppressed; so "GPL version 2" leaves "GPL" no detection of its own. Matches
are placed in one pass over the parts between them, and suppression is one sweep over the sorted detections.

Base phrases are counted apart, are never suppressed, and always keep their labels.

Null and empty texts have no words and no detections; the score is then zero, else the highest
confidence of a detection (of a base phrase 1). Texts of any length are scanned whole. Of equal
intervals of equal priority the first rule's stays. Repeated rows and null ids are scanned as any, an
empty table gives no rows, and columns other than doc_id and text are not read. There is no shuffle:
each row is mapped by itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.license_rules import BASE, Group, groups

_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every pattern and phrase needs one of these; the test of the rules checks it.
STEMS = [
    "licen", "spdx", " cc ", "cc0", "creative", "public domain", "publicdomain", "rights reserved", "gpl", "bsd", " mpl ", " epl ",
    "cddl", "eupl", "cecill", "wtfpl", " org ", " net ", "mariadb com", "mongodb com", "elastic co", "joinup",
    "cecill info", " mit 0 ", "no attribution", "redistribution", "copyright", " software", "hereby granted", "verbatim copies", "remotely through",
    "combined work", "exception", "what the fuck", "confidential", "strictly prohibited", "prior written", "functionality of the program",
    "consequential damages", "acknowledg", "endorse or promote", "derivative works",
]
#: A detection's priority is below this.
PRIORITIES = 8
_PLACE = "STRUCT<first: INT, last: INT, word: BIGINT>"


def joined(text: Column) -> Column:
    """Words with a blank before and after each, in the case of the text."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _NO_WORD, " ")), F.lit(" "))


def _starts(text: Column, pattern: Column | str) -> Column:
    """Structs (first, last, word): character interval and words before each match, in one pass over the text's parts."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))

    def blanks(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")

    def place(done: Column, part: Column) -> Column:
        first = done["at"] + F.length(part["gap"])
        last = first + F.coalesce(F.length(part["match"]), F.lit(0))
        word = done["word"] + blanks(part["gap"])
        here = F.struct(first.alias("first"), last.alias("last"), word.alias("word"))
        out = F.when(part["match"].isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(here)))
        return F.struct(last.alias("at"), (word + F.coalesce(blanks(part["match"]), F.lit(0))).alias("word"), out.alias("out"))

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("word"), F.expr(f"CAST(array() AS ARRAY<{_PLACE}>)").alias("out")
    )
    return F.aggregate(parts, start, place, lambda done: done["out"])


def _detections(text: Column, signatures: list[Group]) -> Column:
    # one constant that the optimizer evaluates once; hundreds of literals would slow planning
    order, table = 0, []
    for group in signatures:
        rows = [{"order": order + k, **rule._asdict()} for k, rule in enumerate(group.rules)]
        order += len(rows)
        table.append({"keywords": group.keywords, "rules": rows})
    rule = "STRUCT<`order`: INT, pattern: STRING, label: STRING, priority: INT, confidence: DOUBLE>"
    known = F.from_json(F.lit(json.dumps(table)), f"ARRAY<STRUCT<keywords: ARRAY<STRING>, rules: ARRAY<{rule}>>>")
    near = F.filter(known, lambda g: F.exists(g["keywords"], lambda k: F.contains(text, k)))
    tried = F.filter(F.flatten(F.transform(near, lambda g: g["rules"])), lambda r: F.regexp_like(text, r["pattern"]))

    def spans(r: Column) -> Column:
        def tagged(s: Column) -> Column:
            return F.struct(
                s["first"].alias("first"),
                (-s["last"]).alias("back"),
                *(r[c].alias(c) for c in ("priority", "order", "label", "confidence")),
            )

        return F.transform(_starts(text, r["pattern"]), tagged)

    return F.flatten(F.transform(tried, spans))


_FOUND = "STRUCT<first: INT, back: INT, priority: INT, `order`: INT, label: STRING, confidence: DOUBLE>"


def _surviving(detections: Column) -> Column:
    """The detections that no other suppresses, by one sweep.

    In order of start, the longest and strongest first, a detection lies within an earlier one exactly
    where one of these ends no sooner. Of the earlier ones, the furthest end is known for each priority and
    all stronger ones; one of equal priority that holds the detection is longer, or equal and earlier.
    """

    def step(done: Column, d: Column) -> Column:
        last = -d["back"]
        beaten = F.element_at(done["ends"], d["priority"] + 1) >= last
        ends = F.transform(done["ends"], lambda end, p: F.when(p >= d["priority"], F.greatest(end, last)).otherwise(end))
        out = F.when(beaten, done["out"]).otherwise(F.concat(done["out"], F.array(d)))
        return F.struct(ends.alias("ends"), out.alias("out"))

    start = F.struct(
        F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"), F.expr(f"CAST(array() AS ARRAY<{_FOUND}>)").alias("out")
    )
    kept = F.aggregate(F.sort_array(detections), start, step, lambda done: done["out"])

    def shown(d: Column) -> Column:
        return F.struct(
            d["first"].alias("first"), (-d["back"]).alias("last"), d["order"].alias("order"), d["label"].alias("label"),
            d["priority"].alias("priority"), d["confidence"].alias("confidence"),
        )

    return F.transform(kept, shown)


def scan(docs: DataFrame, signatures: list[Group] | None = None) -> DataFrame:
    """One row per document row, with the counts, labels, score and surviving detections."""
    signatures = groups() if signatures is None else signatures
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), joined(F.col("text")).alias("t"))
    n_words = F.when(F.length("t") == 2, 0).otherwise(F.length("t") - F.length(F.replace(F.col("t"), F.lit(" "), F.lit(""))) - 1)
    counted = words.select("doc_id", "t", n_words.cast("long").alias("n_words"), F.lower("t").alias("low"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains("low", F.lit(stem))
    gated = counted.select("doc_id", "n_words", F.when(gate, F.translate("t", _UPPER, _UPPER.lower())).alias("t"))
    base = F.array(
        *(
            F.struct(F.lit(label).alias("label"), F.when(F.contains("t", F.lit(f" {p} ")), _starts(F.col("t"), f" {p}(?= )")).alias("at"))
            for p, label in BASE
        )
    )
    base = F.filter(base, lambda b: F.size(b["at"]) > 0)
    none = F.expr(f"CAST(array() AS ARRAY<{_FOUND}>)")
    found = gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("t").isNotNull(), base).alias("base"),
        F.coalesce(F.when(F.col("t").isNotNull(), _detections(F.col("t"), signatures)), none).alias("all"),
    )
    places = F.coalesce(
        F.flatten(F.transform("base", lambda b: F.transform(b["at"], lambda s: s["word"]))), F.expr("CAST(array() AS ARRAY<BIGINT>)")
    )
    names = F.coalesce(F.transform("base", lambda b: b["label"]), F.expr("CAST(array() AS ARRAY<STRING>)"))
    found = found.select("doc_id", "n_words", places.alias("places"), names.alias("names"), _surviving(F.col("all")).alias("detections"))
    labels = F.array_union(F.col("names"), F.transform("detections", lambda d: d["label"]))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "detections",
    )
