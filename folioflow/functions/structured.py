"""Maps, JSON, XML and opaque values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both, the new ones first; absent values of the new one don't count."""
    given = F.map_filter(new, lambda _, v: v.isNotNull() & ~v.isin("", "0"))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(kept, given)


def filled_map(values: Column, names: dict[str, str]) -> Column:
    """Every value of a map with ``__NAME__`` replaced."""

    def one(_, v):
        for name, text in names.items():
            v = F.replace(v, F.lit(f"__{name}__"), F.lit(text))
        return v

    return F.transform_values(values, one)


def json_text(c: Column) -> Column:
    return F.to_json(c)


def xml_text(c: Column, tag: str = "output") -> Column:
    """A nested value as XML."""
    return F.to_xml(c, {"rowTag": tag})


def from_xml_text(c: Column, schema: str, tag: str = "output") -> Column:
    return F.from_xml(c, schema, {"rowTag": tag})


#: What marks a setting's value as an opaque one.
OPAQUE = "json:"


def frozen(c: Column) -> Column:
    """A nested value as a marked string, for a table of strings."""
    return F.concat(F.lit(OPAQUE), F.to_json(c))


def thawed(c: Column) -> Column:
    """The value of a marked string, as a variant; null for a plain one."""
    return F.when(c.startswith(OPAQUE), F.try_parse_json(F.substr(c, F.lit(len(OPAQUE) + 1))))


def encoded(c: Column) -> Column:
    """Bytes of any kind as text, and back."""
    return F.base64(c.cast("binary"))


def decoded(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def tex_to_html(c: Column) -> Column:
    """Emphasis and bold commands as tags."""
    out = F.regexp_replace(c, r"\\(?:emph|textit)\{([^{}]*)\}", "<i>$1</i>")
    out = F.regexp_replace(out, r"\\textbf\{([^{}]*)\}", "<b>$1</b>")
    return F.regexp_replace(F.regexp_replace(out, r"\\textsuperscript\{([^{}]*)\}", "<sup>$1</sup>"), r"\\textsubscript\{([^{}]*)\}", "<sub>$1</sub>")
