"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions import scalars as S
from formloom.plans import fixtures as X
from formloom.plans.catalog import Entry

FULL_WIDTH = "０１２３４５６７８９，．"
HALF_WIDTH = "0123456789,."


def amounts(spark: SparkSession, d: str) -> DataFrame:
    raw = X.from_sql(spark, d, X.AMT_SQL, "lineitem")
    wide = F.translate("raw", HALF_WIDTH, FULL_WIDTH)
    text = F.when(F.col("l_partkey") % 2 == 0, wide).otherwise(F.col("raw"))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw", S.normalize_amount(text).alias("amount")
    )


def date_parts(spark: SparkSession, d: str) -> DataFrame:
    raw = X.from_sql(spark, d, X.DATE_SQL, "orders")
    parts = S.split_composite(F.col("raw"), 3)
    return raw.select("o_orderkey", *[F.get(parts, F.lit(i)).alias(f"p{i + 1}") for i in range(3)])


def nfkc_text(spark: SparkSession, d: str) -> DataFrame:
    raw = X.from_sql(spark, d, X.AMT_SQL, "lineitem")
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.nfkc(F.translate("raw", HALF_WIDTH, FULL_WIDTH)).alias("text"),
    )


def unclear_reasons(spark: SparkSession, d: str) -> DataFrame:
    raw = X.from_sql(spark, d, X.ROW_SQL, "customer")
    return raw.select("page_id", S.unclear_reason(F.col("raw"), F.col("conf")).alias("reason"))


def masked_values(spark: SparkSession, d: str) -> DataFrame:
    """The text of every customer with a confidence per character."""
    raw = X.from_sql(spark, d, X.ROW_SQL, "customer")
    confs = F.transform(
        F.sequence(F.lit(1), F.length("raw")), lambda i: 0.5 + ((F.col("page_id") * 7 + i * 13) % 50) / 100
    )
    masked = S.mask_low_confidence(F.col("raw"), F.when(F.length("raw") > 0, confs).otherwise(F.array().cast("array<double>")))
    return raw.select("page_id", masked.alias("m")).select(
        "page_id", F.col("m.value").alias("value"), F.col("m.kept").alias("kept")
    )


def char_conf_codec(spark: SparkSession, d: str) -> DataFrame:
    """Confidences of an order's lines as text and back."""
    lines = X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 64).alias("confs"),
    )
    text = S.encode_char_confs(F.col("confs"))
    odd = F.when(F.col("l_linenumber") == 1, F.concat(text, F.lit(",nan"))).when(
        F.col("l_linenumber") == 2, F.concat(text, F.lit(",x"))
    ).otherwise(text)
    back = S.parse_char_confs(odd)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("encoded"),
        F.size(back).alias("n"), F.aggregate(back, F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


def shown_confidence(spark: SparkSession, d: str) -> DataFrame:
    raw = X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 64).alias("c")
    )
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.format_conf(F.col("c")).alias("shown")
    )


def composed_status(spark: SparkSession, d: str) -> DataFrame:
    state = X.from_sql(spark, d, X.STATE_SQL, "orders")
    status = (
        F.when(F.col("state") == "failed", F.lit("送信失敗"))
        .when(F.col("template_hash") == "3", F.lit("legacy"))
        .otherwise("")
    )
    return state.select(
        "page_id", S.compose_status(status, F.col("below"), F.col("state") == "done").alias("status")
    )


def page_size_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of scanned sheets against one form size."""
    size = X.table(spark, d, "part").select(
        "p_partkey",
        ((F.col("p_partkey") % 50) * 6 + 1650).alias("w"), (F.col("p_size") * 2 + 1150).alias("h"),
    )
    h = F.when(F.col("p_partkey") % 97 == 0, 0).otherwise(F.col("h"))
    return size.select(
        "p_partkey", S.page_size_verdict(F.col("w"), h, F.lit(1800), F.lit(1200)).alias("verdict")
    )


def allowed_event_keys(spark: SparkSession, d: str) -> DataFrame:
    events = X.table(spark, d, "events")
    line = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","user":"'), F.col("user_id").cast("string"),
                    F.lit('",'), F.substr("props", F.lit(2)))
    kept = S.allow_keys(line, ("type", "k"))
    return events.select(
        "event_id", F.size(kept).alias("keys"), kept["k"].alias("k"), kept["type"].alias("type"),
        F.coalesce(F.try_element_at(kept, F.lit("user")), F.lit("-")).alias("user"),
    )


def redacted_paths(spark: SparkSession, d: str) -> DataFrame:
    return X.from_sql(spark, d, X.DOC_SQL, "documents").select("doc_id", S.redact_paths(F.col("line")).alias("line"))


_W = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_H = r"""\"''()\[\]`,;、。（）「」"""
_PATH_RE = (
    rf"(^|[{_W}{_H}=:])((?:(?i:file://)|[A-Za-z]:[\\/]|\\\\|/[^{_W}{_H}])"
    rf"[^{_W}{_H}]*(?:[{_W}][^{_W}{_H}\\/]*[\\/][^{_W}{_H}]*)*)"
)

ENTRIES = {
    "amounts": Entry(
        amounts,
        f"""WITH r AS ({X.AMT_SQL}), t AS (SELECT *, regexp_replace(trim(raw), '\\s+', ',', 'g') AS s FROM r)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw, CASE WHEN regexp_full_match(s, '[0-9]+') THEN try_cast(s AS BIGINT)
  WHEN regexp_full_match(s, '[0-9]{{1,3}}([,.][0-9]{{3}})+') THEN try_cast(regexp_replace(s, '[,.]', '', 'g') AS BIGINT) END AS amount FROM t""",
    ),
    "date_parts": Entry(
        date_parts,
        f"""WITH r AS ({X.DATE_SQL}), t AS (SELECT o_orderkey, string_split_regex(regexp_replace(raw, '\\s+', '', 'g'), '[.・/,-]') AS p FROM r),
 u AS (SELECT o_orderkey, CASE WHEN len(p) = 3 AND NOT list_contains(p, '') THEN p END AS p FROM t)
 SELECT o_orderkey, p[1] AS p1, p[2] AS p2, p[3] AS p3 FROM u""",
    ),
    "nfkc_text": Entry(
        nfkc_text, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw AS text FROM ({X.AMT_SQL}) r"
    ),
    "unclear_reasons": Entry(
        unclear_reasons,
        f"""SELECT page_id, CASE WHEN contains(raw, chr(7)) THEN 'control' WHEN raw = '' THEN 'empty' WHEN conf IS NULL THEN 'no_conf' WHEN conf < 0.85 THEN 'low_conf' END AS reason
 FROM ({X.ROW_SQL}) r""",
    ),
    "masked_values": Entry(
        masked_values,
        f"""WITH r AS (SELECT page_id, raw, list_transform(range(1, length(raw) + 1), lambda i: (page_id * 7 + i * 13) % 50) AS k FROM ({X.ROW_SQL}) q),
 s AS (SELECT *, len(list_filter(k, lambda v: v < 35)) AS low FROM r)
 SELECT page_id, CASE WHEN low > 0 AND low < len(k) THEN array_to_string(list_transform(range(1, length(raw) + 1), lambda i: CASE WHEN k[i] < 35 THEN '〓' ELSE raw[i] END), '') ELSE '〓' END AS value,
  CASE WHEN low > 0 AND low < len(k) THEN 0.5::DOUBLE + list_min(list_filter(k, lambda v: v >= 35)) / 100.0::DOUBLE END AS kept FROM s""",
    ),
    "char_conf_codec": Entry(
        char_conf_codec,
        """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform([l_discount, l_tax, l_quantity / 64], lambda c: printf('%.3f', c)) AS p FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(p, ',') AS encoded,
  CASE l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 3 END AS n,
  CASE l_linenumber WHEN 2 THEN 0.0 ELSE p[1]::DOUBLE + p[2]::DOUBLE + p[3]::DOUBLE END::DOUBLE AS total FROM r""",
    ),
    "shown_confidence": Entry(
        shown_confidence,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.3f', l_quantity / 64) AS shown FROM lineitem",
    ),
    "composed_status": Entry(
        composed_status,
        f"""SELECT page_id, CASE WHEN state = 'failed' THEN '送信失敗' WHEN state = 'done' AND below >= 3 THEN '超過あり'
  WHEN template_hash = '3' THEN 'legacy' WHEN state = 'done' THEN '正常' ELSE '未処理（中断）' END AS status FROM ({X.STATE_SQL}) s""",
    ),
    "page_size_verdicts": Entry(
        page_size_verdicts,
        """WITH s AS (SELECT p_partkey, (p_partkey % 50) * 6 + 1650 AS w, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size * 2 + 1150 END AS h FROM part)
 SELECT p_partkey, CASE WHEN h <= 0 OR w <= 0 THEN 'mismatch' WHEN abs(w::DOUBLE / h - 1800::DOUBLE / 1200) / (1800::DOUBLE / 1200) > 0.01 THEN 'mismatch' ELSE 'ok' END AS verdict FROM s""",
    ),
    "allowed_event_keys": Entry(
        allowed_event_keys,
        """SELECT event_id, 2 AS keys, json_extract_string(props, '$.k') AS k, event_type AS type, '-' AS "user" FROM events""",
    ),
    "redacted_paths": Entry(
        redacted_paths,
        f"SELECT doc_id, regexp_replace(line, '{_PATH_RE}', '\\1[path]', 'g') AS line FROM ({X.DOC_SQL}) d",
    ),
}
