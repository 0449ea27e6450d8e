"""Share-link configurations and money words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_config(cfg: Column) -> Column:
    """map<string,string> → URL-safe base64 of its JSON, no padding."""
    b64 = F.regexp_replace(F.base64(F.encode(F.to_json(cfg), "UTF-8")), r"[\r\n]", "")
    return F.rtrim(F.translate(b64, "+/", "-_"), F.lit("="))


def decode_config(text: Column) -> Column:
    """The inverse; anything malformed gives an empty map."""
    std = F.translate(text, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(raw, "map<string,string>"), empty)


def share_url(origin: Column, path: Column, floor: Column, cfg: Column) -> Column:
    """The buyer link: the route, the floor when one was picked, the finishes."""
    fl = F.when(floor.isNotNull(), F.concat(F.lit("floor="), floor.cast("string"), F.lit("&"))).otherwise("")
    return F.concat(origin, path, F.lit("?"), fl, F.lit("c="), encode_config(cfg))


def format_taka(n: Column) -> Column:
    """Whole BDT in lakh grouping: 12500000 → 1,25,00,000."""
    s = F.abs(n.cast("bigint")).cast("string")
    head = F.regexp_replace(F.substr(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0))), r"\B(?=(\d{2})+(?!\d))", ",")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(head, F.lit(","), F.right(s, F.lit(3))))


def format_delta(n: Column) -> Column:
    """A price difference in words: Included, +৳…, −৳…"""
    return F.when(n == 0, "Included").otherwise(F.concat(F.when(n > 0, "+").otherwise("−"), F.lit("৳"), format_taka(n)))
