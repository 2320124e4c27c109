"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, merkle, neardup, packing, quality, sharding, simhash, suffixes, topk, trie, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text in ASCII, bit by bit (SQL has no such function)."""
    bit = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    step = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), {step}), 4294967295)"


def merkle_sql(heights: int = 8) -> str:
    """Levels one by one, up to 8^heights rows a group; the tree over groups likewise."""
    counted = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(counted(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""d AS (
          SELECT doc_id, lang, {leaf("text")} AS leaf,
            CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS tampered
          FROM documents)""",
        "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, count(*) AS size FROM d GROUP BY lang)",
        """r AS (
          SELECT d.*, grp, size, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
          FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang)""",
        "a0 AS (SELECT grp, rank AS pos, size AS n, leaf AS digest FROM r)",
    ]
    climb = lambda below: f"SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {below} WHERE n > 1 GROUP BY grp, pos // 8, n"
    for h in range(1, heights + 1):
        ctes.append(f"a{h} AS ({climb(f'a{h - 1}')})")
    ends = " UNION ALL ".join(f"SELECT grp, digest FROM a{h} WHERE n = 1" for h in range(heights + 1))
    ctes += [f"s AS ({ends})", "b0 AS (SELECT 0 AS grp, grp AS pos, count(*) OVER () AS n, digest FROM s)"]
    for h in range(1, heights + 1):
        ctes.append(f"b{h} AS ({climb(f'b{h - 1}')})")
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM b{h} WHERE n = 1" for h in range(heights + 1)) + ")")
    ctes.append("p0 AS (SELECT r.*, s.digest AS subroot, root, tampered AS folded, '' AS proof, rank AS pos FROM r JOIN s USING (grp), root)")
    last = "p0"
    for tree, own in (("a", "grp"), ("b", "0")):
        for h in range(heights):
            if tree == "b" and h == 0:
                ctes.append(f"q AS (SELECT * REPLACE (grp AS pos) FROM {last})")
                last = "q"
            name = f"p{tree}{h}"
            side = lambda op: f"coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos {op} p.pos), '')"  # noqa: B023, E731
            ctes.append(f"""{name}_f AS (
              SELECT p.grp, p.pos, {side("<")} AS lo, {side(">")} AS hi
              FROM (SELECT DISTINCT grp, pos FROM {last}) p JOIN {tree}{h} x ON x.grp = {"p.grp" if own == "grp" else 0} AND x.pos // 8 = p.pos // 8 AND x.n > 1 GROUP BY p.grp, p.pos)""")
            ctes.append(f"""{name} AS (
              SELECT p.* REPLACE (CASE WHEN f.lo IS NULL THEN folded ELSE sha256(lo || folded || hi) END AS folded, proof || coalesce(lo || hi, '') AS proof, p.pos // 8 AS pos)
              FROM {last} p LEFT JOIN {name}_f f ON f.grp = p.grp AND f.pos = p.pos)""")
            last = name
    return f"""WITH {", ".join(ctes)}
      SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"""


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_sharding": op4_sharding,
        "op5_quality": op5_quality,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_language": op7_language,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_warc": op9_warc,
        "op10_bpe": op10_bpe,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_simhash": op12_simhash,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": """
            WITH v AS (
              SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            s AS (
              SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op6_nearest_neighbours": """
            WITH v AS (
              SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
            n AS (SELECT vec_id, v, sqrt(list_reduce([x * x FOR x IN v], lambda a, b: a + b)) AS size FROM v),
            s AS (
              SELECT q.vec_id AS query_id, c.vec_id, list_reduce([z[1] * z[2] FOR z IN list_zip(q.v, c.v)], lambda a, b: a + b) / (q.size * c.size) AS score
              FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op9_warc": """
            WITH p AS (
              SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
            o AS (SELECT digest, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY digest)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
              CASE WHEN original IS NOT NULL AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN original IS NOT NULL AND page_id <> original THEN original END AS refers_to
            FROM p LEFT JOIN o USING (digest)""",
        "op11_prefix_trie": f"""
            WITH t AS (
              SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
              FROM conversations WHERE conv_id IS NOT NULL),
            o AS (
              SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests,
                list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST, digest) AS words
              FROM t GROUP BY conv_id),
            c AS (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM o),
            r AS (
              SELECT c.conv_id, list_concat(coalesce(b.digests[1:h], []), c.digests[h + 1:]) AS digests, list_concat(coalesce(b.words[1:h], []), c.words[h + 1:]) AS words
              FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
            p AS (
              SELECT conv_id, depth, len(digests) AS n, md5(array_to_string(digests[1:depth], '')) AS prefix, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words
              FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS depth FROM r)),
            v AS (
              SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
              FROM p GROUP BY depth, prefix),
            e AS (
              SELECT v.depth, v.prefix, u.conv_id AS parent_conv_id, u.depth AS up_depth, u.prefix AS up_prefix
              FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1 JOIN v u ON u.depth = p.depth AND u.prefix = p.prefix),
            k AS (SELECT up_depth AS depth, up_prefix AS prefix, count(*) AS n_children FROM e GROUP BY ALL),
            w AS (SELECT v.*, parent_conv_id, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN e USING (depth, prefix) LEFT JOIN k USING (depth, prefix)),
            s AS (
              SELECT p.depth, p.prefix, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum(w.saved) AS BIGINT) AS saved_tokens
              FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.prefix)
            SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM w JOIN s USING (depth, prefix)""",
        "op13_merkle": merkle_sql(),
    }
