"""Text expressions: parsing, masking, tokens. Columns in, columns out, no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from logsift import constants as C

# ---- fixed values: masks, in the order they apply; (?U): Unicode digits and boundaries --------
PREFIX_STAMP = (rf"(?U)^\d{{6}}{C.WS}+\d{{6}}{C.WS}+\d+{C.WS}+", "")
BLOCK_ID = (r"(?U)\bblk_-?\d+\b", "<block_id>")
NODE_STAMP = (r"(?U)\b\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}(?:\.\d+)?\b", "<timestamp>")
DATE = (r"(?U)\b\d{4}\.\d{2}\.\d{2}\b", "<date>")
NODE = (r"(?U)\bR\d+-M\d+-(?:N\d+|NB|NE)-C:J\d+-U\d+\b", "<node>")
IP_PORT = (r"(?U)/?\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip_port>")
IP = (r"(?U)/?\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>")
HEX = (r"(?U)\b0x[0-9a-fA-F]+\b", "<hex>")
LONG_NUMBER = (r"(?U)\b\d{3,}\b", "<number>")

SINGLE_DOMAIN = (PREFIX_STAMP, BLOCK_ID, IP_PORT, IP, LONG_NUMBER)
CROSS_DOMAIN = (
    PREFIX_STAMP, BLOCK_ID, NODE_STAMP, DATE, NODE, IP_PORT, IP, HEX, LONG_NUMBER,
)
BLOCK_KEY = r"blk_-?\d+"
EVIDENCE_TOKEN = r"[a-z][a-z0-9_$<>-]*"
KEYWORD_TOKEN = r"[a-z][a-z0-9_-]{2,}"
FEATURE_TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (SQL trim drops spaces only)."""
    return F.btrim(text, F.lit(C.WS_CHARACTERS))


def _mask(text: Column, masks: Sequence[tuple[str, str]]) -> Column:
    masked = strip(text)
    for pattern, label in masks:
        masked = F.regexp_replace(masked, pattern, label)
    return F.lower(strip(F.regexp_replace(masked, C.WS_RUN, " ")))


def normalize_single_domain(text: Column) -> Column:
    """Mask block ids, addresses and long numbers of block logs."""
    return _mask(text, SINGLE_DOMAIN)


def normalize_cross_domain(text: Column) -> Column:
    """B4 plus node names, dates, stamps and hex values."""
    return _mask(text, CROSS_DOMAIN)


def parse_alert_line(line: Column) -> dict[str, Column]:
    """B1: fields of an alert-log line. The alert token never reaches ``message``."""
    clean = strip(line)
    parts = F.split(clean, rf"{C.WS}+", 3)
    first = F.element_at(parts, 1)
    return {
        "timestamp": F.when(F.size(parts) >= 2, F.concat_ws(" ", first, F.get(parts, F.lit(1))))
        .otherwise("unknown"),
        "service": F.lit("bluegene-l"),
        "severity": F.when(first != "-", "ALERT").otherwise("INFO"),
        "message": F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(clean),
        "is_alert": F.when(first != "-", 1).otherwise(0),
    }


def block_keys(line: Column) -> Column:
    """B2: every block id of a line, repeats kept."""
    return F.regexp_extract_all(line, F.lit(BLOCK_KEY), F.lit(0))


def _messages(events: Column) -> Column:
    return F.transform(events, lambda e: F.coalesce(e["message"], F.lit("")))


def incident_text(events: Column, mode: str) -> Column:
    """One text per incident; labels, causes and ids never enter it."""
    messages = _messages(events)
    present = F.filter(messages, lambda m: m != "")
    match mode:
        case "raw_space":
            return F.array_join(messages, " ")
        case "lower_space":
            return F.lower(F.array_join(messages, " "))
        case "raw_newline":
            return F.array_join(present, "\n")
        case "normalized_newline":
            return F.array_join(F.transform(present, normalize_single_domain), "\n")
        case "cross_domain_newline":
            return F.array_join(F.transform(present, normalize_cross_domain), "\n")
    raise ValueError(f"unknown text mode {mode!r}")


def knowledge_text(
    title: Column, service: Column, resolution: Column, symptoms: Column, tags: Column
) -> Column:
    """Searchable text of a knowledge document."""
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.array(title, service, resolution),
        F.coalesce(symptoms, empty),
        F.coalesce(tags, empty),
    )
    return F.lower(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def is_error_message(message: Column) -> Column:
    """B8."""
    return message.rlike(f"(?i){C.ERROR_WORDS}")


def error_template(message: Column) -> Column:
    """Lower case, digits masked."""
    return F.regexp_replace(F.lower(message), r"\d+", "<num>")


def meaningful_tokens(text: Column) -> Column:
    """Distinct technical tokens without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(EVIDENCE_TOKEN), F.lit(0))
    return F.array_except(tokens, F.array(*[F.lit(w) for w in C.EVIDENCE_STOP_WORDS]))


def unique_strings(values: Column) -> Column:
    """Trimmed, non-empty, first occurrence kept in order."""
    cleaned = F.transform(values, strip)
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


def block_order_key(messages: Column) -> Column:
    """Date and time of the first message that starts with them; null if none."""
    pattern = rf"^(\d{{6}}){C.WS}+(\d{{6}}){C.WORD_END}"
    stamped = F.filter(messages, lambda m: m.rlike(pattern))
    first = F.get(stamped, F.lit(0))
    return F.concat(F.regexp_extract(first, pattern, 1), F.regexp_extract(first, pattern, 2))


def window_order_key(incident_id: Column) -> Column:
    """Number at the end of a window id; null if the id has another form."""
    digits = F.regexp_extract(incident_id, r"bgl-window-(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def window_id(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(
        F.lit("bgl-window-"),
        F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0")),
    )


def event_id_sequence(features: Column) -> Column:
    """Event numbers of a trace."""
    return F.transform(
        F.regexp_extract_all(features, F.lit(r"E(\d+)"), F.lit(1)),
        lambda d: d.cast("int"),
    )


def padded_sequence(sequence: Column, max_length: int = 256) -> Column:
    """Cut after ``max_length`` events or fill with zeros behind."""
    kept = F.slice(sequence, 1, max_length)
    return F.concat(kept, F.array_repeat(F.lit(0), F.lit(max_length) - F.size(kept)))


def feature_tokens(text: Column, lowercase: bool = False) -> Column:
    """Word tokens of two or more characters."""
    source = F.lower(text) if lowercase else text
    return F.regexp_extract_all(source, F.lit(FEATURE_TOKEN), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent bigrams."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def without_words(tokens: Column, words: Sequence[str]) -> Column:
    """Drop stop words, keeping order and repeats."""
    return F.filter(tokens, lambda t: ~t.isin(list(words)))
