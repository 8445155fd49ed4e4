"""The queries op1_ to op13_ over the whole tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import decontaminate, fingerprint, packing, quality, resample, rules, secrets, sharding, simhash, urls, variants, warc, wrapper


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op6_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_read(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_read(spark, sf_dir, "documents"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_quality, op3_decontamination, op4_urls, op5_secrets, op6_wrapper, op7_sharding, op8_packing, op9_simhash, op10_fingerprint, op11_resampling, op12_variants, op13_rules)
}

#: CRC-32 of the UTF-8 bytes of ``x`` in DuckDB; ``crcs`` has the table of its 256 remainders.
_CRCS = """crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc(x: str) -> str:
    size, digit = f"octet_length(encode({x}))", f"('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range({size}), lambda i: {digit})), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


_UPPER, _LOWER = f"'{variants.UPPER}'", f"'{variants.LOWER}'"


def _broken(rule: rules.Rule) -> str:
    value = f"{rule.measure}::DOUBLE" + (f" / nullif({rule.per}, 0)" if rule.per else "")
    tests = ([f"{value} < {float(rule.low)}"] if rule.low is not None else []) + ([f"{value} > {float(rule.high)}"] if rule.high is not None else [])
    return f"coalesce({' OR '.join(tests)}, false)"


def _any(some: tuple) -> str:
    return " OR ".join(_broken(r) for r in some)


#: The others hold trained models, hashes or searches that SQL can't say; tests/llm holds them against brute force.
ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             g AS (SELECT *, octet_length(encode(payload)) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS kept FROM p),
             r AS (SELECT *, payload_bytes >= 1000 AND kept IS NOT NULL AND kept IS DISTINCT FROM page_id AS again FROM g)
        SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN kept END AS refers_to
        FROM r""",
    "op11_resampling": rf"""
        WITH {_CRCS},
             raw AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
             d AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
             runs AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS run FROM d),
             hashed AS (SELECT run, {_crc("run")} % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), crcs),
             f AS (SELECT side, r, bucket FROM runs JOIN hashed USING (run)),
             c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
             total AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM c),
             g AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (big_s + 10000) / ((s::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM c, total),
             w AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
             x AS (SELECT d.r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
                          ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r) WHERE side = 0),
             y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
             z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM y)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND rank <= 25 * n // 100 THEN rank END AS rank FROM z""",
    "op12_variants": f"""
        WITH RECURSIVE {_CRCS},
             runs AS (SELECT doc_id, translate(run, {_UPPER}, {_LOWER}) AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
             seen AS (SELECT doc_id, run, length(run) AS size, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
             hashed AS (SELECT *, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM seen, crcs),
             cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % size)::INT) || substr(run, (h % size)::INT + 2) ELSE run END AS word, times FROM hashed),
             words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
             less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
             near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
                      UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
             best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
             forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
             chain AS (SELECT word, word AS tip FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.tip = forms.word WHERE forms.form IS NOT NULL)
        SELECT f.word, n, n_near, f.form, form_n, tip AS root FROM forms f JOIN (SELECT chain.word, tip FROM chain JOIN forms ON tip = forms.word WHERE forms.form IS NULL) e ON e.word = f.word""",
    "op13_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
             w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
             windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS said FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
             again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, said) > 1),
             covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS s(k) GROUP BY r),
             m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                          len(list_filter(ws, lambda x: regexp_matches(x, '{rules.LETTER}'))) AS n_letter_words,
                          len(list_filter(ws, lambda x: regexp_replace(lower(x), '[.,;:]+$', '') IN ({", ".join(f"'{w}'" for w in rules.STOP_WORDS)}))) AS n_stop_words,
                          len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                          len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
                          len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
                          coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r))
        SELECT *, {_any(rules.BASE)} AS base_failed, concat_ws(',', {", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in (*rules.BASE, *rules.RULES))}) AS failed, NOT ({_any((*rules.BASE, *rules.RULES))}) AS kept FROM m""",
}
