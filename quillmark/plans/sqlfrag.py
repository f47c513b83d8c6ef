"""DuckDB SQL fragments for the oracle statements (the same semantics as the Spark
Column functions, written independently in SQL).  DuckDB lambdas use 1-based indexes."""

from __future__ import annotations

# Patterns written out for DuckDB: white space that Python's split() splits on, and
# sentences that end at terminators before white space or at the end.
WHITE_SPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
SENTENCE = r"(?s).+?[.!?]+(?:[ \t\n\r\f\x0B]+|\z)|.+\z"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {q(WHITE_SPACE)}), lambda x: x <> '')"


def tokens(text: str) -> str:
    return words(f"lower({text})")


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    shifted = ", ".join([t] + [f"{t}[{k}:]" for k in range(2, n + 1)])
    parts = ", ".join(f"s[{k}]" for k in range(1, n + 1))
    return f"list_transform(list_zip({shifted}, true), lambda s: concat_ws(' ', {parts}))"


def common(a: str, b: str) -> str:
    return f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"


def sentences(text: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({text}, {q(SENTENCE)}), "
            f"lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')")


def rule(name: str, text: str, w: str = "w") -> str:
    """Rule rewrite; ``w`` names a column holding ``words(text)``."""
    if name == "drop_every_5th":
        out = f"list_filter({w}, lambda x, i: i % 5 <> 0)"
    elif name == "first_half":
        out = f"({w}[1:CAST(ceil(len({w}) / 2) AS BIGINT)])"
    elif name == "lower_strip":
        return f"regexp_replace(lower({text}), '[.,;:!?\"()]', '', 'g')"
    elif name == "reverse_sentences":
        out = f"list_reverse({sentences(text)})"
    elif name == "dedupe_adjacent":
        out = f"list_filter({w}, lambda x, i: i = 1 OR x <> {w}[i - 1])"
    elif name == "swap_pairs":
        out = (f"list_transform({w}, lambda x, i: CASE WHEN i % 2 = 1 AND i < len({w}) THEN {w}[i + 1] "
               f"WHEN i % 2 = 0 THEN {w}[i - 1] ELSE x END)")
    elif name == "long_words":
        out = f"list_filter({w}, lambda x: length(x) >= 4)"
    else:
        raise ValueError(name)
    return f"array_to_string({out}, ' ')"


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"
