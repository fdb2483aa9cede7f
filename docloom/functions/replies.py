"""Reading what a model replied."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _object(text: Column) -> Column:
    """The JSON object that the whole text is, as a variant; null for anything else."""
    found = F.try_parse_json(text)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def unfenced(reply: Column) -> Column:
    """Without a leading line of back ticks, and without a trailing one then."""
    text = F.trim(F.regexp_replace(reply, r"^\s+|\s+$", ""))
    return F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")).otherwise(text)


def extract_json(reply: Column) -> Column:
    """The reply's object as a variant: the whole text, else from its first brace to its last; null where there is none,
    which counts as a plain answer. JSON that isn't an object is a plain answer too."""
    text = unfenced(reply)
    return F.coalesce(_object(text), _object(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def answer(reply: Column) -> Column:
    """The object's answer if that is a string; 'key: value' lines if it is an object; the raw reply for any other value or
    none. A reply without an object is its own answer, stripped."""
    found = extract_json(reply)
    value = F.try_variant_get(found, "$.answer", "variant")
    kind = F.schema_of_variant(value)
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,string>"))
    lines = F.array_join(F.transform(fields, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return (
        F.when(found.isNull(), F.regexp_replace(reply, r"^\s+|\s+$", ""))
        .when(kind == "STRING", F.try_variant_get(found, "$.answer", "string"))
        .when(kind.startswith("OBJECT"), lines)
        .otherwise(reply)
    )


def field(reply_object: Column, item: str, name: str) -> Column:
    """A field of an item's object: 'N/A' if the object lacks it, 'not found' if the item has none. Values become strings."""
    path = lambda *keys: "$" + "".join(f"['{k}']" for k in keys)
    own = F.try_variant_get(reply_object, path(item), "variant")
    is_object = F.coalesce(F.schema_of_variant(own).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.coalesce(F.try_variant_get(reply_object, path(item, name), "string"), F.lit("N/A"))).otherwise(F.lit("not found"))
