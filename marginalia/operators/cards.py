"""Summary cards: grounding in the section's text, caps, synthetic cards and the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, normalize_typography, years_in

ENTITY_KINDS = ("people", "orgs", "products", "technologies", "files_paths", "commands")
CAPS = {"keywords": 8, "questions_answered": 4, "decisions": 4, "action_items": 3, "entities": 6, "dates": 12, "chars": 400}
ENTITIES = "struct<" + ", ".join(f"{k}: array<string>" for k in ENTITY_KINDS) + ">"
CARD_SCHEMA = f"tldr string, summary string, keywords array<string>, questions_answered array<string>, entities {ENTITIES}, mentioned_dates array<struct<raw: string, iso: string, precision: string, evidence: string>>, decisions array<string>, action_items array<string>"


def capped(items: Column, cap: int, chars: int = CAPS["chars"]) -> Column:
    """Clipped, without blanks and repeats, the first ``cap``."""
    plain = F.filter(F.transform(items, lambda x: clip(F.trim(x), chars)), lambda x: x != "")
    return F.slice(F.array_distinct(plain), 1, cap)


def grounded(values: Column, text: Column) -> Column:
    """Values that the text holds, in any case and with plain typography."""
    body = F.lower(normalize_typography(text))
    return F.filter(values, lambda v: (F.trim(v) != "") & F.contains(body, F.lower(normalize_typography(v))))


def iso_parts_hold(iso: Column) -> Column:
    """Whether a date is a day of the calendar, a month, a quarter or a year."""
    day = F.try_to_date(iso, "yyyy-MM-dd").isNotNull() & iso.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return day | iso.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") | iso.rlike(r"^\d{4}-Q[1-4]$") | iso.rlike(r"^\d{4}$")


def grounded_dates(dates: Column, text: Column) -> Column:
    """Dates whose raw form stands in the text and whose year, if the raw form names one, is the same."""
    body = F.lower(normalize_typography(text))

    def holds(d: Column) -> Column:
        years = years_in(d["raw"])
        return (F.trim(d["raw"]) != "") & F.contains(body, F.lower(normalize_typography(d["raw"]))) & iso_parts_hold(d["iso"]) & ((F.size(years) == 0) | F.array_contains(years, F.substring(d["iso"], 1, 4).cast("int")))

    return F.slice(F.filter(dates, lambda d: F.coalesce(holds(d), F.lit(False))), 1, CAPS["dates"])


def validate(cards: DataFrame, text_col: str = "text", card_col: str = "card") -> DataFrame:
    """cards with card (grounded and capped), dropped_entities ("kind:value"), dropped_dates, trimmed (names of lists that were cut)."""
    c, text = F.col(card_col), F.col(text_col)
    kept = {k: capped(grounded(c["entities"][k], text), CAPS["entities"]) for k in ENTITY_KINDS}
    lists = {k: capped(c[k], CAPS[k]) for k in ("keywords", "questions_answered", "decisions", "action_items")}
    dates = grounded_dates(c["mentioned_dates"], text)
    fixed = F.struct(
        clip(F.trim(c["tldr"]), CAPS["chars"]).alias("tldr"), F.trim(c["summary"]).alias("summary"), lists["keywords"].alias("keywords"), lists["questions_answered"].alias("questions_answered"),
        F.struct(*[v.alias(k) for k, v in kept.items()]).alias("entities"), dates.alias("mentioned_dates"), lists["decisions"].alias("decisions"), lists["action_items"].alias("action_items"),
    )
    def named(kind: str) -> Column:
        return F.transform(F.array_except(c["entities"][kind], grounded(c["entities"][kind], text)), lambda v: F.concat(F.lit(kind + ":"), v))

    lost = F.flatten(F.array(*map(named, ENTITY_KINDS)))
    cut = F.array_compact(F.array(*[F.when(F.size(c[k]) > F.size(v), k) for k, v in lists.items()]))
    return cards.withColumns({"card": fixed, "dropped_entities": lost, "dropped_dates": F.array_except(F.transform(c["mentioned_dates"], lambda d: d["raw"]), F.transform(dates, lambda d: d["raw"])), "trimmed": cut})


def read_cards(rows: DataFrame, json_col: str = "summary") -> DataFrame:
    """rows with card parsed from JSON; unknown or missing keys, or no JSON at all, give state failed."""
    known = F.array(*[F.lit(k) for k in ("action_items", "decisions", "entities", "keywords", "mentioned_dates", "questions_answered", "summary", "tldr")])
    keys = F.json_object_keys(json_col)
    sound = keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0) & (F.size(F.array_except(known, keys)) == 0)
    return rows.withColumn("card", F.when(sound, F.from_json(json_col, CARD_SCHEMA))).withColumn("state", F.when(F.coalesce(sound, F.lit(False)), "summarized").otherwise("failed"))


def synthetic(title: Column) -> Column:
    """The card of a section that is nothing but its heading."""
    none = F.array().cast("array<string>")
    return F.struct(
        title.alias("tldr"), title.alias("summary"), none.alias("keywords"), none.alias("questions_answered"), F.struct(*[none.alias(k) for k in ENTITY_KINDS]).alias("entities"),
        F.array().cast("array<struct<raw: string, iso: string, precision: string, evidence: string>>").alias("mentioned_dates"), none.alias("decisions"), none.alias("action_items"),
    )


def index_text(card: Column) -> dict[str, Column]:
    """The card's columns as they are indexed."""
    return {"tldr": card["tldr"], "summary": card["summary"], "keywords": F.array_join(card["keywords"], ", "), "questions_answered": F.array_join(card["questions_answered"], "\n"), "entities": F.array_join(F.flatten(F.array(*[card["entities"][k] for k in ENTITY_KINDS])), ", ")}


#: What is embedded for a card, by variant: its columns in order, one a line.
EMBED_ORDERS = {"tldr": ("tldr",), "summary": ("heading", "tldr", "summary"), "questions": ("heading", "questions_answered", "tldr"), "all": ("heading", "tldr", "summary", "keywords", "questions_answered")}


def embed_text(heading: Column, card: Column, variant: str = "summary") -> Column:
    parts = index_text(card) | {"heading": heading}
    return F.array_join(F.filter(F.array(*[parts[k] for k in EMBED_ORDERS[variant]]), lambda x: x.isNotNull() & (x != "")), "\n")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: signed word counts in hashed places, scaled to length one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), dim)
    # counting per place is one pass over the words for each place; dim is small
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(F.filter(places, lambda p: p == i)) - F.size(F.filter(places, lambda p: p == i + dim))).cast("double"))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(raw, lambda x: x / size)).otherwise(zero)
