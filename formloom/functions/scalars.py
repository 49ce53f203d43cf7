"""Column functions: normalising, masking and classifying values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from formloom.operators.sizing import broadcast_if_small

# The mark for a value that is not trusted, and the statuses.
UNCLEAR = "〓"
STATUS_OK = "正常"
STATUS_OVERFLOW = "超過あり"
STATUS_INTERRUPTED = "未処理（中断）"
FAILURE_STATUSES = (
    "展開失敗",
    "位置合わせ失敗",
    "様式不一致",
    "送信失敗",
    "未処理（送信上限到達）",
    "未処理（中断）",
    "スキップ（重複）",
    "出力失敗",
)
UNCLEAR_THRESHOLD = 0.85
OVERFLOW_MIN = 3
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


# Full-width forms of ASCII and the wide space: the one-to-one part of NFKC.
_WIDE = "".join(chr(0xFF00 + i) for i in range(1, 0x5F)) + "\u3000"
_NARROW = "".join(chr(0x20 + i) for i in range(1, 0x5F)) + " "
# ASCII, marks, kana and ideographs that NFKC leaves as they are and never joins with each other, for a Java character class
_STABLE = r"^[\x00-\x7F\u3001-\u3003\u3005-\u3029\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff]*\z"


def nfkc(text: Column) -> Column:
    """H3: Unicode NFKC. Full-width forms are translated in the JVM.

    Only values with other characters (half-width kana, ligatures, combining marks, other scripts) are normalised in
    Python; for all other rows a null goes there.
    """
    plain = F.translate(text, _WIDE, _NARROW)
    stable = plain.rlike(_STABLE)
    return F.when(stable, plain).otherwise(_nfkc(F.when(~stable, text)))


# white space as Unicode defines it, for a Java character class
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def normalize_amount(raw: Column, normalised: bool = False) -> Column:
    """H1: an amount as a long, or NULL; never repairs.

    Accepts plain digits or groups of three; runs of ideographic commas and
    white space count as one separator. Digits are ASCII after NFKC. A number
    beyond 64 bits is NULL.
    """
    trimmed = F.regexp_replace(raw, rf"^{_SPACE}+|{_SPACE}+$", "")
    s = F.regexp_replace(trimmed if normalised else nfkc(trimmed), rf"(?:、|{_SPACE})+", ",")
    return F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("long")).when(
        s.rlike(r"^[0-9]{1,3}([,.][0-9]{3})+\z"), F.regexp_replace(s, "[,.]", "").try_cast("long")
    )


def split_composite(raw: Column, n: Column | int, normalised: bool = False) -> Column:
    """H2: exactly ``n`` non-empty parts, or NULL."""
    s = F.regexp_replace(raw if normalised else nfkc(raw), rf"{_SPACE}+", "")
    parts = F.split(s, r"[.・/,\-]", -1)
    count = n if isinstance(n, Column) else F.lit(n)
    return F.when((F.size(parts) == count) & F.forall(parts, lambda p: p != ""), parts)


def unclear_reason(raw: Column, conf: Column, threshold: float = UNCLEAR_THRESHOLD) -> Column:
    """Why a value is not trusted, or NULL."""
    return (
        F.when(raw.rlike(CONTROL_CHARS), "control")
        .when(raw == "", "empty")
        .when(conf.isNull() | F.isnan(conf), "no_conf")
        .when(conf < threshold, "low_conf")
    )


def mask_low_confidence(
    raw: Column, char_confs: Column, threshold: float = UNCLEAR_THRESHOLD
) -> Column:
    """H4: mask single characters; all or none below the threshold give one mark.

    Returns a struct of the masked ``value`` and ``kept`` (the lowest
    confidence among the characters that stay, NULL for a full mask). The whole
    value is masked when the confidences do not match its characters.
    """
    confs = F.transform(char_confs, lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c))
    low = F.size(F.filter(confs, lambda c: c < threshold))
    partial = (F.size(confs) == F.length(raw)) & (low > 0) & (low < F.size(confs))
    chars = F.regexp_extract_all(raw, F.lit(r"(?s)."), F.lit(0))
    masked = F.array_join(
        F.zip_with(chars, confs, lambda ch, c: F.when(c < threshold, UNCLEAR).otherwise(ch)), ""
    )
    return F.struct(
        F.when(partial, masked).otherwise(F.lit(UNCLEAR)).alias("value"),
        F.when(partial, F.array_min(F.filter(confs, lambda c: c >= threshold))).alias("kept"),
    )


def encode_char_confs(confs: Column) -> Column:
    """H5: three decimals each, comma separated."""
    return F.array_join(F.transform(confs, lambda c: format_conf(c)), ",")


def parse_char_confs(text: Column) -> Column:
    """H5: back to an array; any unreadable part gives an empty array, NaN and infinities 0.0."""
    parts = F.transform(F.split(text, ",", -1), lambda p: F.trim(p).try_cast("double"))
    fine = (text != "") & F.forall(parts, lambda p: p.isNotNull())
    finite = F.transform(
        parts, lambda p: F.when(F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(p)
    )
    return F.when(fine, finite).otherwise(F.array().cast("array<double>"))


def format_conf(conf: Column) -> Column:
    """H6: three decimals, half to even; for display only, never for the threshold test."""
    return F.when(conf.isNotNull(), F.format_string("%.3f", F.bround(conf, 3)))


def compose_status(status: Column, below: Column, processed: Column) -> Column:
    """H7: the status of an output row."""
    failed = F.when(status.isin(*FAILURE_STATUSES), status)
    over = F.when(processed & (below >= OVERFLOW_MIN), F.lit(STATUS_OVERFLOW))
    joined = F.concat_ws(";", failed, over)
    return (
        F.when(joined != "", joined)
        .when((status != "") & (status != STATUS_OK), status)
        .when(processed, F.lit(STATUS_OK))
        .otherwise(F.lit(STATUS_INTERRUPTED))
    )


def page_size_verdict(w: Column, h: Column, expected_w: Column, expected_h: Column) -> Column:
    """Mismatch when a side is not positive or the aspect differs by more than 1 %."""
    bad = (w <= 0) | (h <= 0) | (expected_w <= 0) | (expected_h <= 0)
    aspect, expected = w / F.nullif(h, F.lit(0)), expected_w / F.nullif(expected_h, F.lit(0))
    return F.when(bad, "mismatch").when(
        F.abs(aspect - expected) / expected > 0.01, "mismatch"
    ).otherwise("ok")


def expected_digits(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Text cells without subfields whose name says how many digits they hold.

    ``rules`` (pattern, digits, rule) is a short table, one row per naming rule.
    """
    return (
        cells.filter((F.col("kind") == "text") & (F.size("subfields") == 0))
        .join(broadcast_if_small(rules, 1_000), F.expr("field_id rlike pattern"))
        .drop("pattern")
    )


def allow_keys(event: Column, allowed: tuple[str, ...]) -> Column:
    """The entries of a JSON object whose key is allowed, as a map."""
    return F.map_filter(
        F.from_json(event, "map<string,string>"), lambda k, _: k.isin(*allowed) if allowed else F.lit(False)
    )


# Characters at which a path run ends for certain.
_HARD = r"""\"'()\[\]`,;、。（）「」"""
_WHITE = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = rf"[^{_WHITE}{_HARD}]"
# A path starts at a left boundary with a file URI, a drive, a share or a slash.
# White space belongs to it while the next word still holds a separator.
PATH_PATTERN = (
    rf"(?<![^{_WHITE}{_HARD}=:])(?:(?i:file://)|[A-Za-z]:[\\/]|\\\\|/(?={_WORD}))"
    rf"{_WORD}*+(?:[{_WHITE}](?=[^{_WHITE}{_HARD}\\/]*[\\/]){_WORD}*+)*+"
)


def redact_paths(text: Column) -> Column:
    """Replace absolute paths in free text by ``[path]``; when in doubt it hides more."""
    return F.regexp_replace(text, PATH_PATTERN, "[path]")
