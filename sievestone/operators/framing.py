"""Framing of questions: relations, facets, mentions, pronouns, interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Cues of relation families; a question has every family one of whose cues it contains.
RELATION_CUES = {
    "birth": ("born", "birth", "birthplace"),
    "death": ("died", "death"),
    "date": ("when", "date", "year"),
    "location": ("where", "located", "place", "capital"),
    "quantity": ("how many", "how much", "population", "distance", "height"),
    "quotation": ("who said", "quote", "quotation", "stated", "wrote"),
    "definition": ("what is", "what are", "define", "meaning"),
    "comparison": ("compare", "difference", "larger", "smaller", "older", "newer"),
    "cause": ("why", "reason", "cause", "because"),
    "membership": ("member", "part of", "belongs", "included"),
    "event": ("happened", "occurred", "event"),
}
#: Words that open a question and name nothing.
OPENERS = ("who", "what", "when", "where", "why", "which", "how", "is", "are", "was", "were", "did", "does", "do", "can", "could", "would", "name", "list", "compare", "find", "i", "in", "tell", "using")
#: Goals by the first word, question words, words without content, pronouns.
GOALS = {"who": "identify", "what": "describe", "when": "locate", "where": "locate", "why": "explain", "how": "explain"}
QUESTION_WORDS = ("what", "which", "who", "whom", "whose", "when", "where", "why", "how")
EMPTY_WORDS = (*QUESTION_WORDS, "the", "a", "an", "is", "was", "were", "are", "did", "do", "does", "to", "of", "in", "on", "and", "or", "for", "from", "with", "that")
PRONOUNS = ("it", "its", "they", "them", "their", "he", "she")
#: Facets that an answer of each shape needs besides source_support and entity_resolution.
SHAPE_FACETS = {"date": ("time",), "quantity": ("quantity",), "person": ("object",), "place": ("location",), "statement": ("object",), "span": ("object",)}

#: A run of up to six capitalised words, small words between them; a quotation; a pronoun. Groups: before, surface, after.
CAPITALISED = r"(^|[^\p{L}\p{N}_'-])((?:[A-Z][\p{L}\p{N}_'-]*(?:\s+(?:of|the|and|de|van)\s+|\s+)){0,5}[A-Z][\p{L}\p{N}_'-]*)()"
QUOTED = "([\"“])([^\"”]{2,200})([\"”])"
PRONOUN = rf"(^|[^\p{{L}}\p{{N}}_'-])({'|'.join(sorted(PRONOUNS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_'-])()"


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def relation_tags(question: Column) -> Column:
    """The relation families that the question has a cue of, in their fixed order."""
    low = F.lower(question)
    found = [F.when(F.greatest(*(low.contains(c).cast("int") for c in cues), F.lit(0)) == 1, name) for name, cues in RELATION_CUES.items()]
    return F.array_compact(F.array(*found))


def facets_for_shape(shape: Column) -> Column:
    """source_support, entity_resolution and the shape's own facets."""
    own = F.create_map(*(x for name, facets in SHAPE_FACETS.items() for x in (F.lit(name), _words(facets))))
    return F.concat(_words(("source_support", "entity_resolution")), F.coalesce(F.element_at(own, shape), _words(("object",))))


def mentions(question: Column) -> Column:
    """array<struct<char_start, char_end, surface>>: capitalised runs but for question openers, and quotations not inside one."""
    runs = F.filter(T.spans(question, CAPITALISED), lambda m: ~F.lower(m["surface"]).isin(*OPENERS))
    quoted = F.filter(T.spans(question, QUOTED), lambda q: ~F.exists(runs, lambda m: (m["char_start"] <= q["char_start"]) & (q["char_end"] <= m["char_end"])))
    return F.array_sort(F.concat(runs, quoted))


def bind_pronouns(turns: DataFrame, chat: str, turn: str, question: str, surfaces: str) -> DataFrame:
    """Every pronoun with the last two entities named in earlier turns; confidence 0.9 for exactly one entity, else 0.45.

    Only two lists of two travel along a chat, never all its entities, so long chats need no
    long buffers. Rows: chat, turn, ordinal, pronoun, antecedents, confidence.
    """
    before = Window.partitionBy(chat).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    named = F.size(surfaces) > 0
    held = turns.withColumn("_known", F.coalesce(F.sum(F.size(surfaces)).over(before), F.lit(0))).withColumn("_prior", F.last(F.when(named, F.element_at(surfaces, -1)), ignorenulls=True).over(before))
    both = F.concat(F.array_compact(F.array("_prior")), F.slice(F.col(surfaces), F.greatest(F.size(surfaces) - 1, F.lit(1)), 2))
    tail = F.when(named, F.slice(both, F.greatest(F.size(both) - 1, F.lit(1)), 2))
    held = held.withColumn("_two", F.coalesce(F.last(tail, ignorenulls=True).over(before), F.array().cast("array<string>")))
    out = held.select(chat, turn, "_two", "_known", F.posexplode(T.spans(F.lower(question), PRONOUN)).alias("ordinal", "_p"))
    return out.select(chat, turn, "ordinal", F.col("_p.surface").alias("pronoun"), F.col("_two").alias("antecedents"), F.when(F.col("_known") == 1, 0.9).otherwise(0.45).alias("confidence"))


def interpretation(question: Column) -> dict[str, Column]:
    """The parts of a reading: goal, information type, entities, open pronouns, years, facets, unknown words."""
    words = F.regexp_extract_all(question, F.lit(r"([\p{L}\p{N}_'-]+)"), 1)
    low = F.transform(words, lambda x: F.lower(x))
    first = F.coalesce(F.get(low, F.lit(0)), F.lit(""))
    goal = F.lit("verify")
    for word, name in GOALS.items():
        goal = F.when(first == word, name).otherwise(goal)
    entities = F.array_distinct(F.transform(F.filter(T.spans(question, CAPITALISED), lambda m: ~F.lower(m["surface"]).isin(*QUESTION_WORDS)), lambda m: m["surface"]))
    return {
        "goal": F.when(F.arrays_overlap(low, _words(("compare", "difference", "versus"))), "compare").otherwise(goal),
        "information_type": F.when(first.isin(*QUESTION_WORDS), first).otherwise("verification"),
        "entities": entities,
        "unresolved": F.filter(low, lambda x: x.isin(*PRONOUNS)),
        "years": F.regexp_extract_all(question, F.lit(r"\b(1[5-9][0-9]{2}|20[0-9]{2}|2100)\b"), 1),
        "facets": F.when(F.size(entities) > 0, _words(("source_support", "entity_resolution"))).otherwise(_words(("source_support",))),
        "unknown": F.filter(words, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*EMPTY_WORDS)),
    }
