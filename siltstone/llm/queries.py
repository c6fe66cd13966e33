"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them.

Every query applies its operator to the whole of its table with the production parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import decode, encode
from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.embedding_dedup import near_duplicates
from siltstone.llm.frames import shared_dir
from siltstone.llm.pii import AFTER, BEFORE, IP_VALID, KEEP_SCORE, KINDS, find_pii
from siltstone.llm import quality, toxicity
from siltstone.llm.jaccard_join import jaccard_join
from siltstone.llm.labelled import fold
from siltstone.llm.line_dedup import DEPTH, MIN_DOCS, MIN_TOKENS, SHARE, dedup_lines
from siltstone.llm.secret_scan import BASE_RULES, RULES, find_secrets
from siltstone.llm.warc import read_warc, write_warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows of ten words."""
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        _sha(F.array_join("item_ids", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = rf"""
WITH words_of AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
    FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), doc_windows AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM words_of, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(w) - n + 2)) AS r(i)
), found AS (
    SELECT doc_id, i, n, item_id FROM doc_windows JOIN windows USING (n, win)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _spans_sql(table: str, kinds: list[tuple[str, str, str, int]], base: list[str]) -> str:
    """SQL that finds spans by regular expressions: (kind, pattern, condition on match m, group whose text m is)."""
    q = lambda s: s.replace("'", "''")
    found = []
    for rank, (kind, pattern, condition, group) in enumerate(kinds):
        # Matches and the pieces between them alternate, so positions are running sums of lengths.
        found.append(f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, x.s AS s, x.e AS e FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0),
            'e': list_sum(list_transform(p[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))),
            'm': g[i], 'before': p[i], 'after': p[i + 1]}})) AS x
        FROM (SELECT doc_id, regexp_extract_all(t, '{q(pattern)}') AS m, regexp_extract_all(t, '{q(pattern)}', {group}) AS g,
                     string_split_regex(t, '{q(pattern)}') AS p FROM texts)) WHERE {condition}""")
    names = ", ".join(f"'{b}'" for b in base)
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{b}') AS BIGINT) AS n_{b}" for b in base)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), found AS ({" UNION ALL ".join(found)}
), per AS (
    SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (kind IN ({names})) AS base,
           string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (doc_id)
"""


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    found = find_pii(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    spans, base = F.col("pii"), [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(_count(spans, k) for k in base),
        _sha(_digest(F.filter(spans, lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        _digest(spans).alias("spans"),
    )


def _op1_sql() -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    bare = "replace(x.m, ' ', '')"
    luhn = f"""(list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, CAST(length({digits}) - i AS BIGINT), 1) AS INT)
        ELSE (2 * CAST(substr({digits}, CAST(length({digits}) - i AS BIGINT), 1) AS INT)) // 10 + (2 * CAST(substr({digits}, CAST(length({digits}) - i AS BIGINT), 1) AS INT)) % 10 END)) % 10 = 0)"""
    mod97 = f"""(list_reduce(list_prepend(0, list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97) = 1)"""
    confirmed = {
        "email": "true",
        "ip": f"regexp_matches(x.m, '{IP_VALID}')",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": mod97,
        "ssn": "NOT regexp_matches(x.before, '[0-9-]$') AND NOT regexp_matches(x.after, '^[0-9-]')",
    }
    kinds = []
    for k in KINDS:
        around = f"lower(right(x.before, {BEFORE}) || ' | ' || left(x.after, {AFTER}))"
        score = f"round({k.score} + CASE WHEN regexp_matches({around}, '{k.near}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches({around}, '{k.far}') THEN 0.3 ELSE 0 END, 6)"
        kinds.append((k.name, k.plain, confirmed[k.name] + ("" if k.base else f" AND {score} >= {KEEP_SCORE}"), 0))
    return _spans_sql("documents", kinds, [k.name for k in KINDS if k.base])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents."""
    found = find_secrets(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    spans, base = F.col("secrets"), [r.kind for r in BASE_RULES]
    return found.select(
        "doc_id",
        *(_count(spans, k) for k in base),
        _sha(_digest(F.filter(spans, lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        _digest(spans).alias("spans"),
    )


def _op9_sql() -> str:
    either = lambda p: re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p)
    kinds = []
    for r in RULES:
        p = r.pattern
        if r.ignore_case:  # the keywords stand before the first class
            words, rest = p.split("[", 1)
            p = f"{either(words)}[{rest}"
        kinds.append((r.kind, p, f"length(x.m) >= {r.min_len}", r.group))
    return _spans_sql("documents", kinds, [r.kind for r in BASE_RULES])


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings."""
    return near_duplicates(_read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT vec_id, CAST((SELECT count(*) FROM pairs WHERE a = vec_id) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)
"""


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, number and digest of the ids of each text, and the digest of what they decode to."""
    path, pattern = vocabulary()
    found = decode(encode(docs, path, pattern, keep=["doc_id"]), path)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded."""
    return encoded_digests(_read(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by their five-word shingles: the class of each (its least document), and its links."""
    return jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "component_id", "n_links", "kept")


OP5_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
roots AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a AS doc_id, count(*) AS n FROM pairs GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, w.doc_id = c AS kept
FROM w JOIN roots USING (doc_id) LEFT JOIN links USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for quality."""
    docs = _read(spark, sf_dir, "documents")
    net = quality.fit(docs, _read(spark, sf_dir, "labels"), folds=4, held_out=2)
    return quality.score(docs, net, keep=["doc_id"]).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates."""
    found = dedup_lines(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", _sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


OP7_SQL = rf"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
raw AS (SELECT doc_id, i - 1 AS n, list_transform(regexp_extract_all(p[i], '[^\x00-\x20]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*> ' ELSE t END) AS w
        FROM parts, unnest(range(1, len(p) + 1)) AS r(i)),
every AS (SELECT doc_id, n, w, array_to_string(w[1:{DEPTH}], ' ') || ' ' || len(w) AS leaf FROM raw WHERE len(w) >= {MIN_TOKENS}),
kinds AS (SELECT leaf, w, count(DISTINCT doc_id) AS docs, min({{'k': doc_id, 'n': n}}) AS rep FROM every GROUP BY leaf, w),
tokens AS (SELECT leaf, w, docs, p, w[p] AS token FROM kinds, unnest(range(1, len(w) + 1)) AS r(p)),
constants AS (SELECT leaf, p, token FROM tokens GROUP BY leaf, p, token HAVING sum(docs) >= {MIN_DOCS}),
fits AS (SELECT leaf, w FROM tokens JOIN constants USING (leaf, p, token) GROUP BY leaf, w HAVING count(*) >= {SHARE} * len(w)),
instances AS (SELECT kinds.* FROM kinds JOIN fits USING (leaf, w)),
heads AS (SELECT leaf, min(rep) AS head FROM instances GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS}),
gone AS (SELECT doc_id, n FROM every JOIN instances USING (leaf, w) JOIN heads USING (leaf) WHERE {{'k': doc_id, 'n': n}} <> head),
per AS (SELECT doc_id, list(n) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN g IS NULL THEN coalesce(text, '') ELSE
           coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(g, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)), '') END) AS text_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for toxicity."""
    docs = _read(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _read(spark, sf_dir, "labels"), folds=3, held_out=1)
    return toxicity.score(docs, net, keep=["doc_id"]).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        toxicity.toxic(F.col("score")).alias("predicted"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives in the shared folder and read back."""
    folder = shared_dir(spark)
    write_warc(_read(spark, sf_dir, "pages"), folder, null_keys=True)
    return read_warc(spark, folder, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
bits AS (
    SELECT page_id, strlen(body) AS n, sha256(body) AS sha,
           list_reduce(list_transform(string_split(sha1(body), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), lambda a, b: a || b) AS b
    FROM bodies
), named AS (
    SELECT page_id, n, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), lambda x, y: x || y) AS digest,
           max(page_id) OVER (PARTITION BY sha, n) AS head
    FROM bits
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM named
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this package, by name."""
    return {"op1_pii": op1_pii, "op2_decontaminate": op2_decontaminate, "op3_embeddings": op3_embeddings, "op4_bpe": op4_bpe, "op5_jaccard": op5_jaccard, "op6_quality": op6_quality, "op7_lines": op7_lines, "op8_toxicity": op8_toxicity, "op9_secrets": op9_secrets, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    return {"op1_pii": _op1_sql(), "op2_decontaminate": OP2_SQL, "op3_embeddings": OP3_SQL, "op5_jaccard": OP5_SQL, "op7_lines": OP7_SQL, "op9_secrets": _op9_sql(), "op10_warc": OP10_SQL}
