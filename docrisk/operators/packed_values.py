"""Several values packed in one field: split by delimiter skeletons, one row per value with its place.

A cell is cut into tokens: quoted text, known names, numbering, delimiters, conjunctions and
ordinary characters. A conjunction between two known or quoted values becomes a delimiter, any other
an ordinary word. The cell's skeleton is what is left when all values are masked and repeated
delimiters dropped: its kinds of delimiters in the order of their first place. There are at most 65
skeletons, whatever the data; the rule of each (which kinds separate) is worked out once, and the
table of rules is a broadcast of that size. Values are then taken out by the places of the separating tokens.
"""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters, quotes, numbering and conjunctions.
DELIMITERS = "、，,;；/／|｜·・•\t\n\r　"
QUOTED = r"\"[^\"]*\"|“[^”]*”|'[^']*'|‘[^’]*’|「[^」]*」|《[^》]*》"
NUMBERING = r"[①-⑳❶-❿]|[（(]\d{1,2}[)）]|(?<![\w.])\d{1,2}[.)）](?=\s|[^\d.\s])"
CONJUNCTIONS = "以及|和|及|与|&|＆|(?<![A-Za-z])and(?![A-Za-z])"
BLANK = r"[  ]"


SEPARATORS = "dwnb"  # delimiter, wide blank, numbering, single blank
MARK = "\ufdd0"  # stands for separating tokens; Unicode has set this code point aside from text


def _names(names: list[str]) -> str:
    """Pattern of the known names as a tree of their letters, so that its cost doesn't grow with the list.

    The longest name wins; ASCII ends must not touch other ASCII letters or digits.
    """
    tree: dict = {}
    for n in names:
        if n:
            node = tree
            for c in n:
                node = node.setdefault(c, {})
            node[""] = "(?![A-Za-z0-9])" if n[-1].isascii() and n[-1].isalnum() else ""

    def pattern(node: dict) -> str:
        longer = [re.sub(r"([^\w\s])", r"\\\1", c) + pattern(node[c]) for c in sorted(node) if c]
        return f"(?:{'|'.join(longer + ([node['']] if '' in node else []))})"

    ends = [("(?<![A-Za-z0-9])" if c.isascii() and c.isalnum() else "") + re.sub(r"([^\w\s])", r"\\\1", c) + pattern(tree[c]) for c in sorted(tree)]
    return "|".join(ends) or r"(?!)"


def _token_pattern(names: str) -> str:
    special = f"{QUOTED}|{names}|{BLANK}*(?:{NUMBERING}){BLANK}*|{BLANK}*[{DELIMITERS}]\\s*|{BLANK}{{2,}}|{BLANK}*(?:{CONJUNCTIONS}){BLANK}*|{BLANK}"
    return f"{special}|(?:(?!{special})[^\\s])+|\\s"


def token_class(token: Column, names: list[str]) -> Column:
    """q quoted, k known name, n numbering, d delimiter, w wide blank, c conjunction, b single blank, x other."""
    return (
        F.when(token.rlike(f"^(?:{QUOTED})$"), "q").when(token.isin(names) if names else F.lit(False), "k")
        .when(token.rlike(f"^{BLANK}{{2,}}$"), "w").when(token.rlike(f"^{BLANK}$"), "b")
        .when(token.rlike(f"^{BLANK}*(?:{NUMBERING}){BLANK}*$"), "n").when(token.rlike(f"^{BLANK}*[{DELIMITERS}]\\s*$"), "d")
        .when(token.rlike(f"^{BLANK}*(?:{CONJUNCTIONS}){BLANK}*$"), "c").otherwise("x")
    )


def masked(kinds: Column) -> Column:
    """The string of token classes without conjunctions: one between known or quoted values (a proficiency word
    may stand before the second) separates like a delimiter, any other is an ordinary word."""
    return F.translate(F.regexp_replace(kinds, "(?<=[qk][bw]{0,99})c(?=[bw]*x?[qk])", "d"), "c", "x")


def skeleton(kinds: Column) -> Column:
    """The kinds of delimiters in the order of their first place."""
    return F.array_join(F.array_distinct(F.split(F.regexp_replace(kinds, f"[^{SEPARATORS}]", ""), "")), "")


def resolve(skeleton: str) -> str:
    """The kinds of tokens that separate: a single blank only if nothing else does."""
    return "dwn" if set(skeleton) & set("dwn") else SEPARATORS


def rules() -> list[tuple[str, str]]:
    """(skeleton, separators) of every possible skeleton."""
    return [("".join(p), resolve("".join(p))) for n in range(len(SEPARATORS) + 1) for p in permutations(SEPARATORS, n)]


def _unquoted(value: Column) -> Column:
    value = F.regexp_replace(value, r"^[\s　]+|[\s　]+$", "")
    inner = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"^[\s　]+|[\s　]+$", "")
    return F.when(value.rlike(f"^(?:{QUOTED})$"), inner).otherwise(value)


def packed_cells(df: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """(field_name, key, line_no, cell) of a string column (line 0) or of the lines of an array column."""
    if df.schema[field].dataType.typeName() == "array":
        return df.select(F.lit(field).alias("field_name"), key, F.posexplode(field).alias("line_no", "cell"))
    return df.select(F.lit(field).alias("field_name"), key, F.lit(0).alias("line_no"), F.col(field).alias("cell"))


def split_values(cells: DataFrame, cell: str, names: list[str], keep: list[str]) -> DataFrame:
    """(keep..., item_no, item_text) of every non-empty value of the column ``cell``.

    ``item_no`` counts the non-empty values of a cell from 1. Null, empty and blank cells and cells of
    delimiters only give no rows; repeated rows give repeated results. ``names`` are protected:
    nothing inside them separates. One pass without a shuffle.
    """
    names = sorted({n for n in names if n})
    pattern = _token_pattern(_names(names))
    tokens = (
        cells.where(F.col(cell).rlike(r"[^\s　]"))
        .select(*keep, F.regexp_extract_all(F.translate(cell, MARK, " "), F.lit(pattern), F.lit(0)).alias("_tokens"))
        .withColumn("_kinds", masked(F.array_join(F.transform("_tokens", lambda t: token_class(t, names)), "")))
        .withColumn("_skeleton", skeleton(F.col("_kinds")))
    )
    table = cells.sparkSession.createDataFrame(rules(), "_skeleton string, _separators string")
    joined = tokens.join(F.broadcast(table), "_skeleton")
    marked = F.transform("_tokens", lambda t, i: F.when(F.expr("_separators").contains(F.substr("_kinds", i + 1, F.lit(1))), F.lit(MARK)).otherwise(t))
    values = F.transform(F.split(F.array_join(marked, ""), f"{MARK}+"), _unquoted)
    return (
        joined.select(*keep, F.posexplode(F.filter(values, lambda v: v != "")).alias("_k", "item_text"))
        .select(*keep, (F.col("_k") + 1).cast("int").alias("item_no"), "item_text")
    )
