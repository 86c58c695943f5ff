"""Claims out of marked-up pages: infobox fields, defining and event sentences, typed mentions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Field names that tell a kind, and parts of names of fields that state no fact.
DATE_FIELDS = ("birth date", "death date", "date", "date formed", "date founded", "date opened", "established date", "formation", "founded", "start date", "end date", "year", "year start", "year end")
QUANTITY_FIELDS = ("area", "area total", "distance", "elevation", "height", "length", "mass", "population", "population total", "weight", "width")
EVENT_FIELDS = ("event", "formation", "founded", "opened", "established")
LOCATION_PARTS = ("birth place", "death place", "location", "country", "capital")
NO_FACT_PARTS = ("alt", "caption", "image", "logo", "map", "module", "pushpin", "style", "template")
#: Months, units, and how many mentions of a kind a page gives.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
UNITS = r"%|percent|km|kilomet(?:er|re)s?|miles?|m|met(?:er|re)s?|cm|mm|kg|kilograms?|g|grams?|tonnes?|tons?|lit(?:er|re)s?|people|inhabitants?|years?|months?|days?|hours?|minutes?|seconds?|million|billion"
DATE = rf"(?i:(?:[0-3]?[0-9]\s+)?(?:{MONTHS})\s+(?:[0-3]?[0-9],?\s+)?(?:1[0-9]{{3}}|20[0-9]{{2}}))"
YEAR = r"(?:1[0-9]{3}|20[0-9]{2}|2100)"
NUMBER = r"[-+]?[0-9]+(?:[,.][0-9]+)?(?:\s*(?:-|to)\s*[0-9]+(?:[,.][0-9]+)?)?"
QUANTITY = rf"(?i:{NUMBER}\s*(?:{UNITS}))"
MENTIONS = {"date mentioned": ("date", 2), "year mentioned": ("date", 3), "quantity mentioned": ("quantity", 3), "quotation": ("quotation", 2)}
SENTENCES = {"definition": ("text", 2), "event": ("event", 2)}

_EDGE, _END = r"(^|[^\p{L}\p{N}_])", r"((?![\p{L}\p{N}_]))"
PATTERNS = {
    "date mentioned": f"{_EDGE}({DATE}){_END}", "year mentioned": f"{_EDGE}({YEAR}){_END}", "quantity mentioned": f"{_EDGE}({QUANTITY}){_END}", "quotation": "([\"“])([^\"”\n]{5,240})([\"”])",
    "definition": r"((?:^|\n)\s*)([^{}\n\s][^{}\n]{2,119}?\b(?i:is|are|was|were)\b[^{}\n]{4,360}?[.!?])()",
    "event": r"((?:^|\n)\s*)([^{}\n\s][^{}\n]{2,359}?\b(?i:occurred|happened|began|ended|was founded|was opened|was launched|was created)\b[^{}\n]{0,240}?[.!?])()",
}


def template_end(text: str, start: int) -> int:
    """Where the template that opens at start closes, start itself if it never does."""
    depth = 0
    for mark in re.compile(r"\{\{|\}\}").finditer(text, start):
        depth += 1 if mark.group() == "{{" else -1
        if depth == 0:
            return mark.end()
    return start


def infobox_fields(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, field, value, char_start, char_end) of the first infobox of every page; fields without a value or a fact are left out."""
    opening = re.compile(r"\{\{\s*infobox\b", re.I)
    line = re.compile(r"^\s*\|\s*([A-Za-z][A-Za-z0-9 _-]{0,63})\s*=[^\S\n]*([^\n]*?)[^\S\n]*$", re.M)
    markup = re.compile(r"(?:<!--.*?-->|<ref\b.*?</ref>|<ref\b[^>]*/>)", re.I)

    def fields(text: str) -> list[tuple[str, str, int, int]]:
        box = opening.search(text)
        end = template_end(text, box.start()) if box else 0
        found = []
        for m in line.finditer(text, box.start(), end) if box and end > box.start() else ():
            name, value = " ".join(m.group(1).replace("_", " ").casefold().split()), m.group(2)
            if value and value not in ("-", "—", "N/A", "n/a") and not markup.fullmatch(value) and not any(p in name for p in NO_FACT_PARTS):
                found.append((name, value, m.start(2), m.end(2)))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *f) for i, text in zip(batch[id_col], batch[text_col], strict=True) for k, f in enumerate(fields(text or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "field", "value", "char_start", "char_end"])

    return pages.where(F.col(text_col).rlike(r"(?i)\{\{\s*infobox\b")).select(id_col, text_col).mapInPandas(run, f"{id_col} long, ordinal long, field string, value string, char_start long, char_end long")


def field_kind(field: Column, value: Column) -> Column:
    """The kind of a field's value, by its name first, then by its shape."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(field.isin(*DATE_FIELDS) | whole(DATE) | whole(YEAR), "date").when(field.isin(*QUANTITY_FIELDS) | whole(QUANTITY), "quantity")
        .when(field.isin(*EVENT_FIELDS), "event").when(field.rlike("|".join(LOCATION_PARTS)), "location")
        .when(whole("[\"“][^\"”\n]{5,240}[\"”]"), "quotation").when(whole(r"\[\[[^\]|#]+(?:#[^\]|]*)?(?:\|[^\]]+)?\]\]"), "entity").otherwise("text")
    )


def visible(value: Column) -> Column:
    """What a reader sees of a value: a link's label, else its target."""
    link = r"^\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]+))?\]\]$"
    return F.when(value.rlike(link), F.coalesce(F.nullif(F.regexp_extract(value, link, 2), F.lit("")), F.regexp_extract(value, link, 1))).otherwise(value)


def sentence_claims(pages: DataFrame, id_col: str, text_col: str, title_col: str | None = None, lead: int | None = None) -> DataFrame:
    """(id, relation, kind, ordinal, value, char_start, char_end): definitions that name the title, events, dates, years, quantities, quotations.

    Each relation gives its first few, as fixed above. lead reads only that many characters;
    without it whole texts are read.
    """
    text = F.col(text_col) if lead is None else F.substring(text_col, 1, lead)
    title = F.lower(F.col(title_col)) if title_col else F.lit("")
    kinds = SENTENCES | MENTIONS

    def places(relation: str) -> Column:
        found = T.spans(text, PATTERNS[relation])
        if relation == "definition":
            found = F.filter(found, lambda m: F.lower(F.regexp_replace(m["surface"], "'{2,5}", "")).contains(title))
        return F.slice(found, 1, kinds[relation][1])

    every = F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(kinds[r][0]).alias("kind"), places(r).alias("places")) for r in kinds))
    out = pages.select(id_col, F.explode(every).alias("r")).select(id_col, "r.relation", "r.kind", F.posexplode("r.places").alias("ordinal", "m"))
    return out.select(id_col, "relation", "kind", F.col("ordinal").cast("long").alias("ordinal"), F.trim(F.col("m.surface")).alias("value"), F.col("m.char_start").cast("long").alias("char_start"), F.col("m.char_end").cast("long").alias("char_end"))


def page_claims(pages: DataFrame, id_col: str, text_col: str, title_col: str | None = None, most: int = 32) -> DataFrame:
    """Infobox and sentence claims of pages that are no redirects, equal ones once, at most `most` a page in page order."""
    held = pages.where(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"(?i)^\s*#redirect\b"))
    box = infobox_fields(held, id_col, text_col).select(
        id_col, F.concat(F.lit("infobox "), "field").alias("relation"), field_kind(F.col("field"), F.col("value")).alias("kind"), F.lit(0).alias("part"), "ordinal", visible(F.col("value")).alias("value"), "char_start", "char_end",
    )
    part = F.element_at(F.create_map(*(x for i, r in enumerate(SENTENCES | MENTIONS, 1) for x in (F.lit(r), F.lit(i)))), F.col("relation"))
    said = sentence_claims(held, id_col, text_col, title_col).withColumn("part", part)
    key = [id_col, "relation", "value", "char_start", "char_end"]
    once = box.unionByName(said).groupBy(*key).agg(F.min(F.struct("part", "ordinal", "kind")).alias("x"))
    w = Window.partitionBy(id_col).orderBy("x.part", "x.ordinal", "relation")
    return once.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select(*key, F.col("x.kind").alias("kind"), "place")


def context(text: Column, start: Column, end: Column, width: int = 96) -> Column:
    """The text around a span, `width` characters on either side, cut at its ends."""
    left = F.greatest(start - width, F.lit(0))
    return F.substring(text, left.cast("int") + 1, (F.least(end + width, F.length(text)) - left).cast("int"))
