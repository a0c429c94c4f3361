"""DuckDB statements for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM items)
),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
),
found AS (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, g)),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""




def _merkle(levels: int = 9) -> str:
    """The manifest with the tree's levels written out: as many as 8 ** 9 documents a language need."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    bits = "list_reduce(list_prepend({0}, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    table = f"(SELECT list({bits.format('k')} ORDER BY k) FROM range(256) t(k))"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), "
        "lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)))"
    )
    parts = [
        f"crc AS (SELECT {table} AS crc_table)",
        f"""docs AS (
  SELECT doc_id, lang, text, source, n_chars, {leaf("text")} AS leaf,
         {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
         coalesce({crc} % 3 = 0, false) AS chosen
  FROM documents, crc
)""",
        """leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         CASE WHEN chosen THEN lowered ELSE leaf END AS seen
  FROM docs
)""",
    ]

    def tree(name: str, source: str) -> None:
        """Levels name_0, name_1, ..: lane, place, digest, and what stands left and right of it in its run."""
        run = "PARTITION BY lane, i // 8 ORDER BY i"
        for k in range(levels + 1):
            rows = source if k == 0 else (
                f"SELECT lane, i // 8 AS i, CASE WHEN any_value(size) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d "
                f"FROM {name}_{k - 1} GROUP BY lane, i // 8"
            )
            parts.append(
                f"""{name}_{k} AS (
  SELECT lane, i, d, count(*) OVER (PARTITION BY lane) AS size,
         coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM ({rows})
)"""
            )

    def climbed(name: str, base: str, lane: str) -> None:
        """Proof and folded digest of the rows of base, one level after the other."""
        for k in range(levels):
            below = base if k == 0 else f"{base}_{name}_{k - 1}"
            parts.append(
                f"""{base}_{name}_{k} AS (
  SELECT b.* REPLACE (b.proof || t.l || t.r AS proof,
                      CASE WHEN t.size = 1 THEN b.folded ELSE sha256(t.l || b.folded || t.r) END AS folded,
                      b.place // 8 AS place)
  FROM {below} b JOIN {name}_{k} t ON t.lane IS NOT DISTINCT FROM {lane} AND t.i = b.place
)"""
            )

    tree("t", "SELECT lang AS lane, i, leaf AS d FROM leaves")
    parts.append(f"roots AS (SELECT lane AS lang, d AS subroot, row_number() OVER (ORDER BY lane NULLS FIRST) - 1 AS j FROM t_{levels})")
    tree("s", "SELECT 0 AS lane, j AS i, subroot AS d FROM roots")
    parts.append("own AS (SELECT doc_id, lang, leaf, i AS place, seen AS folded, '' AS proof FROM leaves)")
    climbed("t", "own", "b.lang")
    parts.append(
        f"""up AS (
  SELECT b.* EXCLUDE (place), r.subroot, r.j AS place
  FROM own_t_{levels - 1} b JOIN roots r ON r.lang IS NOT DISTINCT FROM b.lang
)"""
    )
    climbed("s", "up", "0")
    return "WITH " + ",\n".join(parts) + (
        f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM up_s_{levels - 1}, (SELECT d AS root FROM s_{levels})
"""
    )


OP12 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
windows AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 5
"""


def statements() -> dict[str, str]:
    return {
        "op7_embeddings": OP7,
        "op10_decontaminate": OP10,
        "op12_hard_negatives": OP12,
        "op13_manifest": _merkle(),
    }
