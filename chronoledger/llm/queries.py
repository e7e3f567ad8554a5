"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, sharding, url_cascade, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(_table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return bpe.digest_round_trip(_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)


def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = {shard: 1.0 for shard in range(17)}
    return sharding.shard_records(_table(spark, sf_dir, "documents"), {s: even[s] for s in range(16)}, even)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


#: Rules of the url filter; the longest that fits decides.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(_table(spark, sf_dir, "pages"), url_cascade.parse_rules(URL_RULES))


#: Target weights of the sources, in hundredths; the rest of them share 6.
MIX_WEIGHTS = {"src0": 12, **{f"src{i}": 8 for i in range(1, 5)}, **{f"src{i}": 4 for i in range(5, 10)}, **{f"src{i}": 3 for i in range(10, 20)}}
MIX_OTHER, MIX_BLOCK_BYTES = 6, 65_536


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_BLOCK_BYTES, MIX_OTHER)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.base_report(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    scored = quality_classifier.score_texts(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_rendezvous": op3_rendezvous,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_cascade": op5_url_cascade,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_ranking": op10_quality_ranking,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (t)""",
    "op5_url_cascade": r"""
        WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS url FROM pages),
        h AS (SELECT page_id, CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*') ELSE '' END AS raw,
                CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
        r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        m AS (SELECT page_id, max_by(rhost || rpath, len(rhost || rpath)) AS rule, max_by(action, len(rhost || rpath)) AS action
              FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op7_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op8_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM i),
        rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
        b AS (SELECT m.doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
                CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                len(string_split(text, chr(10))) AS all_lines,
                len(regexp_replace(text, '[^!]', '', 'g')) AS excl,
                len(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS caps, len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
              FROM m LEFT JOIN cov USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR n_symbols * 10 > n_words OR excl * 5 > n_words OR caps * 2 > letters OR letters * 2 < word_chars
               OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_dup_lines * 2 > all_lines) AS kept
        FROM f""",
}
