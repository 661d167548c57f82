"""SQL fragments shared by the oracles."""

from __future__ import annotations

WS = r"\s"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def _chain(expr: str, steps: list[tuple[str, str]]) -> str:
    out = strip(expr)
    for pattern, label in steps:
        out = f"regexp_replace({out}, '{pattern}', '{label}', 'g')"
    return f"lower({strip(out)})"


# ---- fixed values: the masks --------------------------------------------------------
_STAMP = (r"^\d{6}\s+\d{6}\s+\d+\s+", "")
_BLOCK = (r"\bblk_-?\d+\b", "<block_id>")
_IP_PORT = (r"/?\b(?:\d{1,3}\.){3}\d{1,3}:\d+\b", "<ip_port>")
_IP = (r"/?\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>")
_NUMBER = (r"\b\d{3,}\b", "<number>")
_SPACE = (r"\s+", " ")


def single_domain(expr: str) -> str:
    return _chain(expr, [_STAMP, _BLOCK, _IP_PORT, _IP, _NUMBER, _SPACE])


def cross_domain(expr: str) -> str:
    return _chain(expr, [
        _STAMP, _BLOCK,
        (r"\b\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}(?:\.\d+)?\b", "<timestamp>"),
        (r"\b\d{4}\.\d{2}\.\d{2}\b", "<date>"),
        (r"\bR\d+-M\d+-(?:N\d+|NB|NE)-C:J\d+-U\d+\b", "<node>"),
        _IP_PORT, _IP, (r"\b0x[0-9a-fA-F]+\b", "<hex>"), _NUMBER, _SPACE,
    ])


def tokens(expr: str, lower: bool = False) -> str:
    return f"regexp_extract_all({f'lower({expr})' if lower else expr}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def grams(tokens_expr: str) -> str:
    """Unigrams and adjacent bigrams of a token list column."""
    return (
        f"list_concat({tokens_expr}, list_transform(range(1, len({tokens_expr})), "
        f"lambda i: {tokens_expr}[i] || ' ' || {tokens_expr}[i + 1]))"
    )


def evidence_tokens(expr: str) -> str:
    stop = "'a','an','and','at','for','from','in','of','on','the','to','with','is','was','info'"
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({expr}), '[a-z][a-z0-9_$<>-]*')), "
        f"lambda t: NOT list_contains([{stop}], t))"
    )


def tfidf(
    name: str, source: str, fit: str, *, id_column: str = "doc_id", lower: bool = False,
    min_df: int = 1, sublinear: bool = True, stop: tuple[str, ...] = (),
) -> str:
    """CTEs ``{name}``(id, term, w): unit TF-IDF of ``source`` under the vocabulary of ``fit``."""
    toks = tokens("text", lower)
    if stop:  # before bigrams are formed
        toks = f"list_filter({toks}, lambda t: NOT list_contains([{', '.join(repr(w) for w in stop)}], t))"

    def counted(alias: str, relation: str) -> str:
        return f"""{alias} AS (
  SELECT {id_column}, term, count(*) AS tf FROM (
    SELECT {id_column}, unnest({grams('toks')}) AS term
    FROM (SELECT {id_column}, {toks} AS toks FROM {relation}))
  GROUP BY 1, 2)"""
    weight = "1.0 + ln(tf)" if sublinear else "CAST(tf AS DOUBLE)"
    return f"""{counted(name + '_fit', fit)},
{name}_vocabulary AS (
  SELECT term, count(*) AS df,
    ln((1.0 + (SELECT count(*) FROM {fit})) / (1.0 + count(*))) + 1.0 AS idf
  FROM {name}_fit GROUP BY term HAVING count(*) >= {min_df}),
{counted(name + '_counts', source)},
{name}_raw AS (
  SELECT {id_column}, term, ({weight}) * idf AS w
  FROM {name}_counts JOIN {name}_vocabulary USING (term)),
{name} AS (
  SELECT {id_column}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {id_column})) AS w
  FROM {name}_raw)"""


def values(numbers) -> str:
    """A grid as a VALUES list of exact doubles."""
    return ", ".join(f"({float(n)!r}::DOUBLE)" for n in numbers)
