"""Bulk edits of tags: operations in sequence, each seeing what the earlier ones left."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.operators.rules import Condition, condition

OPERATIONS = ("set", "add", "remove", "clear", "transform", "copy", "rename", "map", "capitalize")


@dataclass(frozen=True)
class Edit:
    """One operation on a column. `strategy` says what `set` does with another value that is there: replace it, skip,
    or merge (arrays only; others are replaced). `source` is the column that copy reads, `old` the value that rename
    replaces, `pattern` one substitution such as s/find/replace/i or several with bars between; map looks its value up in
    the table `value`, capitalize makes the first letter of each word large. All conditions must hold, and all of `where`:
    pairs of a column and what it must be (see edit_condition)."""

    name: str
    column: str
    operation: str
    value: object = None
    pattern: str = ""
    source: str = ""
    old: object = None
    strategy: str = "replace"
    conditions: tuple[Condition, ...] = ()
    where: tuple[tuple[str, object], ...] = ()


def edit_condition(df: DataFrame, column: str, expected: object) -> Column:
    """Whether a column is as an edit plan expects, never null: the same value, null for null; or, of a table of `contains`,
    `equals` and `regex`, the first of these that it has. Case counts; a number is no text; an array contains what one of its
    values contains."""
    if column not in df.columns:
        known = expected.get("equals") if isinstance(expected, dict) and "equals" in expected else expected
        return F.lit(known is None)
    now, kind = F.col(column), df.schema[column].dataType.typeName()
    if isinstance(expected, dict):
        texts = now.cast("array<string>") if kind == "array" else F.array(now.cast("string"))
        if expected.get("contains"):
            return F.coalesce(F.exists(texts, lambda t: t.contains(str(expected["contains"]))), F.lit(False))
        if "regex" in expected:
            return F.coalesce(F.exists(texts, lambda t: (t != "") & t.rlike(str(expected["regex"]))), F.lit(False))
        return edit_condition(df, column, expected["equals"]) if "equals" in expected else F.lit(True)
    if expected is None:
        return now.isNull()
    if kind == "array":
        values = expected if isinstance(expected, (list, tuple)) else None
        return F.lit(False) if values is None else F.coalesce(now == F.array(*map(F.lit, values)).cast(df.schema[column].dataType), F.lit(False))
    if isinstance(expected, str) != (kind == "string"):
        return F.lit(False)
    return F.coalesce(now == F.lit(expected), F.lit(False))


def substitution(pattern: str) -> tuple[str, str]:
    """Regular expression and replacement in Spark's form; a slash behind a backslash is part of them."""
    parts = [part.replace("\\/", "/") for part in re.split(r"(?<!\\)/", pattern)]
    if len(parts) < 3 or parts[0] != "s":
        raise ValueError(f"not a substitution: {pattern!r}")
    flags = parts[3] if len(parts) > 3 else ""
    return ("(?i)" if "i" in flags else "") + parts[1], re.sub(r"\\(\d)", r"$\1", parts[2])


def capitalized(text: Column) -> Column:
    """The first letter of each word large, the others as they are."""
    words = F.split(text, "(?U)(?<=\\W)(?=\\w)")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def substituted(text: Column, pattern: str) -> Column:
    """Substitutions one after the other; a replacement that asks for a large letter capitalizes words."""
    for one in re.split(r"(?<=/)\|(?=s/)|(?<=/[gi])\|(?=s/)|(?<=/[gi]{2})\|(?=s/)", pattern):
        find, put = substitution(one)
        text = capitalized(text) if "\\U" in put else F.regexp_replace(text, find, put)
    return text


def _edited(df: DataFrame, edit: Edit) -> Column:
    """The column's new value, conditions aside."""
    now, is_array = F.col(edit.column), df.schema[edit.column].dataType.typeName() == "array"
    kind = df.schema[edit.column].dataType
    if edit.operation == "clear":
        return F.lit(None).cast(kind)
    if edit.operation == "set":
        value = F.array(*[F.lit(v) for v in edit.value]) if isinstance(edit.value, (list, tuple)) else F.lit(edit.value)
        if is_array and not isinstance(edit.value, (list, tuple)):
            value = F.array(value)
        if edit.strategy == "skip":
            return F.coalesce(now, value.cast(kind))
        if edit.strategy == "merge" and is_array:
            return F.coalesce(F.array_union(now, value.cast(kind)), value.cast(kind))
        return value.cast(kind)
    if edit.operation == "add":
        return F.array_union(F.coalesce(now, F.array().cast(kind)), F.array(F.lit(edit.value)).cast(kind))
    if edit.operation == "remove":
        left = F.array_remove(now, F.lit(edit.value)) if is_array else F.when(now != F.lit(edit.value), now)
        return F.when(F.size(left) > 0, left) if is_array else left
    if edit.operation == "transform":
        text = now if is_array else now.cast("string")
        return F.transform(text, lambda v: substituted(v, edit.pattern)) if is_array else substituted(text, edit.pattern).cast(kind)
    if edit.operation == "capitalize":
        return F.transform(now, capitalized) if is_array else capitalized(now)
    if edit.operation == "map":
        cells = [F.lit(x) for pair in edit.value.items() for x in pair]
        look = lambda v: F.coalesce(F.element_at(F.create_map(*cells), v), v)
        return F.transform(now, look) if is_array else look(now)
    if edit.operation == "copy":
        source = F.col(edit.source)
        if is_array and df.schema[edit.source].dataType.typeName() != "array":
            return F.when(F.trim(source.cast("string")) != "", F.array(source).cast(kind)).otherwise(now)
        filled = F.size(source) > 0 if df.schema[edit.source].dataType.typeName() == "array" else F.trim(source.cast("string")) != ""
        return F.when(filled, source.cast(kind)).otherwise(now)
    if edit.operation == "rename":
        old, new = F.lit(edit.old), F.lit(edit.value)
        return F.transform(now, lambda v: F.when(v == old, new).otherwise(v)) if is_array else F.when(now == old, new).otherwise(now)
    raise ValueError(f"unknown operation: {edit.operation!r}")


def apply_edits(df: DataFrame, edits: list[Edit]) -> DataFrame:
    """`df` with the edits made, and `applied`: names of the edits that changed the row, in order. Empty input stays
    empty; a condition on a null value sees empty text."""
    out = df.withColumn("applied", F.array().cast("array<string>"))
    for edit in edits:
        wanted = F.lit(True)
        for c in edit.conditions:
            wanted = wanted & condition(c)
        for column, expected in edit.where:
            wanted = wanted & edit_condition(out, column, expected)
        value = F.when(wanted, _edited(out, edit)).otherwise(F.col(edit.column))
        changed = ~value.eqNullSafe(F.col(edit.column))
        # both read the row as it was before this edit
        out = out.withColumns({edit.column: value, "applied": F.when(changed, F.array_append("applied", F.lit(edit.name))).otherwise(F.col("applied"))})
    return out


def edit_result(edited: DataFrame) -> DataFrame:
    """(edit, changed): rows that each edit changed, and `rows` under which any did or none."""
    status = F.when(F.size("applied") > 0, "success").otherwise("skipped")
    names = F.concat(F.array(status), F.col("applied"))
    return edited.select(F.explode(names).alias("edit")).groupBy("edit").agg(F.count(F.lit(1)).alias("changed"))


def undo_log(df: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """Rows of `df` as they were, of those that an edit changed."""
    return df.join(edited.filter(F.size("applied") > 0).select(key), key, "left_semi")


def set_genre(genre: str, strategy: str = "replace") -> Edit:
    return Edit("set genre", "genre", "set", genre, strategy=strategy)


def set_year(year: int, strategy: str = "replace") -> Edit:
    return Edit("set year", "year", "set", year, strategy=strategy)


def add_artist(artist: str) -> Edit:
    return Edit("add artist", "artists", "add", artist)


def remove_artist(artist: str) -> Edit:
    return Edit("remove artist", "artists", "remove", artist)


def rename_artist(old: str, new: str) -> Edit:
    return Edit("rename artist", "artists", "rename", new, old=old)


def standardize_genre(genres: dict[str, str]) -> Edit:
    """Genres that are in the table get its spelling."""
    return Edit("standardize genre", "genre", "map", genres)


def capitalize_fields(fields: list[str]) -> list[Edit]:
    return [Edit(f"capitalize {field}", field, "capitalize") for field in fields]


def fix_track_numbers(prefix: str = "") -> Edit:
    """A number with or without the prefix, and with anything behind it, becomes the prefix and the number."""
    return Edit("fix track numbers", "track_number", "transform", pattern=f"s/^({prefix})?(\\d+).*/{prefix}\\2/g")


def copy_album_to_artist_if_missing() -> Edit:
    """The album as the artist of rows whose artists are null."""
    return Edit("album as artist", "artists", "copy", source="album", where=(("artists", None),))
