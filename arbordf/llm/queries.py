"""The queries of this subpackage, by name, with production parameters; and their SQL, where SQL can
express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .binpack import packed
from .common import WORD, n_words, table
from .imatch import fingerprints
from .minhash import near_duplicates
from .mixing import mixed
from .pii import BASE, personal_data
from .quality import scored
from .secrets import labelled_findings, secrets
from .token_packing import round_trip as token_files_and_back
from .warc import round_trip


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"])
    return rows.select("doc_id", "source", "lang", "evidence", "site_rate", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


#: The mixing query's tree: domains by number of the source, weights by name (1 where none is given).
DOMAIN_SQL = """CASE WHEN NOT regexp_like(coalesce(source, ''), '^src[0-9]{1,6}$') THEN 'other'
    WHEN cast(substr(source, 4) AS int) < 5 THEN 'web' WHEN cast(substr(source, 4) AS int) < 10 THEN 'news'
    WHEN cast(substr(source, 4) AS int) < 15 THEN 'books' ELSE 'forum' END"""
WEIGHTS = {"domain": {"web": 4, "news": 3, "books": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 3, "src7": 2}}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL), WEIGHTS, share=(6, 10), max_epochs=2, seed=1)
    return rows.select("doc_id", "mix_domain", "lang", "source", "n_tokens", "epoch")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_and_back(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").withColumn("n_tokens", n_words()))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), labelled_findings(spark))


QUERIES = {"op1_minhash": op1_minhash, "op2_quality": op2_quality, "op3_mixing": op3_mixing, "op4_tokens": op4_tokens, "op5_ann": op5_ann, "op6_imatch": op6_imatch, "op7_warc": op7_warc, "op8_binpack": op8_binpack, "op9_pii": op9_pii, "op10_secrets": op10_secrets}


def _weight(level: str) -> str:
    return f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())} ELSE 1 END"


def _shared(rows: str, parents: str, child: str) -> str:
    """SQL that adds ``part`` to rows with w, cap and budget, as mixing.shared does."""
    by = f"PARTITION BY {parents} ORDER BY cap::DOUBLE / w, {child}"
    return f"""SELECT * EXCLUDE (part), least(cap, part)::BIGINT AS part FROM (
        SELECT *, CASE WHEN saturated THEN cap ELSE (room * run) // w_left - (room * (run - w)) // w_left END AS part FROM (
            SELECT *, budget::HUGEINT - coalesce(sum(CASE WHEN saturated THEN cap END) OVER (PARTITION BY {parents}), 0) AS room,
                sum(CASE WHEN NOT saturated THEN w END) OVER (PARTITION BY {parents}) AS w_left,
                sum(CASE WHEN saturated THEN 0 ELSE w END) OVER ({by} ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, cap::HUGEINT * sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                    <= (budget - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * w AS saturated
                FROM ({rows}))))"""


OP3_SQL = f"""
    WITH d AS (SELECT doc_id, lang AS own_lang, source AS own_source, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {DOMAIN_SQL.replace("regexp_like", "regexp_matches")} AS domain,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap, {_weight("source")} AS w FROM d GROUP BY 1, 2, 3),
    langs AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_weight("lang")} AS w FROM leaves GROUP BY 1, 2),
    domains AS (SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, {_weight("domain")} AS w, (SELECT sum(tokens) * 6 // 10 FROM leaves)::BIGINT AS budget FROM langs GROUP BY domain),
    b1 AS ({_shared("FROM domains", "root", "domain")}),
    b2 AS ({_shared("SELECT langs.*, b1.part AS budget FROM langs JOIN b1 USING (domain)", "domain", "lang")}),
    b3 AS ({_shared("SELECT leaves.*, b2.part AS budget FROM leaves JOIN b2 USING (domain, lang)", "domain, lang", "source")}),
    goals AS (SELECT domain, lang, source, part // tokens AS whole, part % tokens AS rest FROM b3 WHERE tokens > 0),
    o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('1:' || whole || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
        FROM d JOIN goals USING (domain, lang, source)),
    c AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM o)
    SELECT doc_id, domain AS mix_domain, own_lang AS lang, own_source AS source, n_tokens, unnest(range(copies))::INT AS epoch FROM c"""

#: Exact links between rows by counting common shingles over all rows, and their components by a recursive closure.
OP1_SQL = """
    WITH RECURSIVE d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, text) AS row FROM documents),
    w AS (SELECT row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    s AS (SELECT DISTINCT row, doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT row, doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
    c AS (SELECT a.row AS x, b.row AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.row <> b.row AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT x, y FROM c JOIN n p ON p.row = x JOIN n q ON q.row = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
    r AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
    m AS (SELECT a AS row, min(doc_id) AS component_id FROM r JOIN d ON d.row = r.b GROUP BY a)
    SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, TRUE) AS kept FROM d JOIN m USING (row) LEFT JOIN n USING (row)"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op7_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, url
        FROM f""",
}
