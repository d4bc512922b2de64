"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.llm import language, toxicity
from playtrail.llm.chats import format_chats, read_back
from playtrail.llm.common import fold, share_folder
from playtrail.llm.decontamination import decontaminate
from playtrail.llm.filter_audit import audit_filters
from playtrail.llm.jaccard import jaccard_components
from playtrail.llm.language_model import score_texts
from playtrail.llm.licenses import scan_licenses
from playtrail.llm.mixing import mix_sources
from playtrail.llm.neighbours import nearest
from playtrail.llm.resampling import resample
from playtrail.llm.substrings import remove_repeats
from playtrail.llm.tokens import count_tokens

#: Target weights of the mixture; sources not listed weigh 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


ORACLES["op1_mix_sources"] = f"""
WITH RECURSIVE sized AS (
    SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size,
           CASE WHEN sum(coalesce(length(text), 0)) > 0 THEN
               CASE source {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} ELSE 1::DOUBLE END
           ELSE 0::DOUBLE END AS weight
    FROM documents GROUP BY source
), rates AS (
    SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM sized) * (SELECT sum(size) FROM sized) / size
                   ELSE 0::DOUBLE END AS rate
    FROM sized
), terms AS (
    SELECT source, rate, ceil(rate / 4)::INTEGER AS parts, rate / ceil(rate / 4)::INTEGER AS mean, 0 AS k,
           exp(-(rate / ceil(rate / 4)::INTEGER)) AS p, exp(-(rate / ceil(rate / 4)::INTEGER)) AS cdf
    FROM rates WHERE rate > 0
    UNION ALL
    SELECT source, rate, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM terms WHERE k < 31
), tables AS (
    SELECT source, rate, parts, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source, rate, parts
), drawn AS (
    SELECT d.*, t.rate, '17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) AS key,
           list_sum(list_transform(range(1, t.parts + 1), lambda i: len(list_filter(t.cdfs, lambda c: c <=
               ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) || ':' || i), 1, 13))::BIGINT
               / 4503599627370496::DOUBLE)))) AS n
    FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, rate, copy::INTEGER AS copy, md5(key || '#' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn)
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_ASCII_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_decontaminate"] = f"""
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS row, {_ASCII_WORDS.format(_LOWER.format('text'))} AS w FROM documents
), item AS (
    SELECT DISTINCT item_id::VARCHAR AS item, {_ASCII_WORDS.format(_LOWER.format('text'))} AS w FROM benchmark
), item_at AS (
    SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS n FROM item_at
), doc_at AS (
    SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM doc
), runs AS (
    SELECT row, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS win
    FROM doc_at, (SELECT DISTINCT n FROM windows) s WHERE i + s.n - 1 <= len(w)
), found AS (
    SELECT row, i, runs.n, item FROM runs JOIN windows USING (win)
), hit AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM found) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = language.learn(table(spark, sf_dir, "documents"), fold("doc_id", 4) != 2)
    predicted = language.predict(texts(spark, sf_dir), field)
    return predicted.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept words are joined by one space, also where nothing was removed."""
    found = remove_repeats(texts(spark, sf_dir))
    words = F.expr(r"array_join(filter(split(coalesce(kept, ''), '[ \t-\r]+'), w -> w <> ''), ' ')")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


_SPACED_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op5_remove_repeats"] = f"""
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS row, {_SPACED_WORDS.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
    SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35
), windows AS (
    SELECT row, i, array_to_string(w[i:i + 34], ' ') AS win FROM starts
), repeated AS (
    SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT row, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (win)
), words AS (
    SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc
), kept AS (
    SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (row)
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = toxicity.learn(texts(spark, sf_dir), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = toxicity.score_toxicity(texts(spark, sf_dir), machine)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", predicted)


@query
def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run encodes every distinct text."""
    import public_tokenizers

    cache = f"{share_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = count_tokens(texts(spark, sf_dir), cache, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(texts(spark, sf_dir)).drop("text")


@query
def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(texts(spark, sf_dir))


@query
def op10_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the texts outside the test fold, the weights on one fold in six of them."""
    scored = score_texts(texts(spark, sf_dir), fold("doc_id", 7) != 2, fold("doc_id", 7) == 6)
    return scored.withColumn("held_out", fold("doc_id", 7) == 2)


ORACLES["op9_jaccard_components"] = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, {_SPACED_WORDS.format(_LOWER.format('text'))} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM doc WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


#: One more conversation, whose texts look like the template's marks.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query
def op11_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the id are computed from the formatted examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    found = read_back(format_chats(turns.union(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("losses", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLES["op11_format_chats"] = rf"""
WITH turns AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
), sized AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id, alone) AS n,
           24 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'))
           + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS size
    FROM turns WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
), summed AS (
    SELECT *, sum(size) OVER (PARTITION BY conv_id, alone ORDER BY pos) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id, alone
"""


@query
def op12_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, table(spark, sf_dir, "labels"))


ORACLES["op12_audit_filters"] = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPACED_WORDS.format("coalesce(text, '')")} AS w
    FROM documents
), marks AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
           CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc.doc_id > min(doc.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM doc LEFT JOIN marks USING (doc_id)
), cells AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL
), orders AS (
    SELECT '' AS o UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)
), steps AS (
    SELECT part, o, step, n, good, toxic, fails, substr(o, step, 1) AS f, contains(fails, substr(o, step, 1)) AS here,
           NOT regexp_matches(fails, '[' || substr(o, 1, step - 1) || '_]') AS alive
    FROM cells, (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)
), summed AS (
    SELECT part, o AS filter_order, step::INT AS step, f,
           sum(CASE WHEN alive AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN alive AND here THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN NOT alive AND here THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN alive AND here THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN alive AND here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""


@query
def op13_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_resample_to_target"] = f"""
WITH side AS (
    SELECT 0 AS target, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 1, 0, NULL, text FROM benchmark
), doc AS (
    SELECT target, row, doc_id, {_ASCII_WORDS.format(_LOWER.format('text'))} AS w FROM side
), grams AS (
    SELECT target, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
           || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
    FROM doc
), counted AS (
    SELECT target, row, g, count(*) AS n FROM grams GROUP BY ALL
), remainders AS (
    SELECT list(list_reduce(range(0, 8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b)
           ORDER BY b) AS t
    FROM range(256) r(b)
), coded AS (
    SELECT g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda i:
                  ('0x' || substr(hex(encode(g)), 2 * i::INT + 1, 2))::BIGINT),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT g FROM counted), remainders
), placed AS (
    SELECT target, row, bucket, sum(n) AS n FROM counted JOIN coded USING (g) GROUP BY ALL
), shares AS (
    SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM placed GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM shares) + 10000)::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM shares) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM shares
), weights AS (
    SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM placed JOIN gains USING (bucket) WHERE target = 0 GROUP BY row
), scored AS (
    SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM doc LEFT JOIN weights USING (row) WHERE target = 0
), ranked AS (
    SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place,
           5 * count(*) FILTER (words >= 20) OVER () // 100 AS wanted
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM ranked
"""
