"""Transcripts to memories: lexicons are data, classification is a few column expressions per row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Word lists, all given by the caller. Lists are fixed and small, so they become expressions, not joins."""

    emotions: dict[str, tuple[str, ...]]
    types: dict[str, tuple[str, ...]]  # in order of precedence
    people: tuple[str, ...] = ()
    songs: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    high: tuple[str, ...] = ()
    low: tuple[str, ...] = ()
    core: tuple[str, ...] = ("breakthrough", "identity", "promise")
    patterns: dict[str, str] = field(default_factory=dict)  # regular expression by emotion


def any_of(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def hits(low: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def chord(low: Column, lexicon: Lexicon) -> Column:
    """0.3 and 0.2 for each word of an emotion that occurs, 1 at most; emotions without words are left out."""
    entries = F.array(*[F.struct(F.lit(e).alias("k"), F.when(hits(low, ws) > 0, F.round(F.least(F.lit(1.0), 0.3 + 0.2 * hits(low, ws)), 2)).alias("v")) for e, ws in lexicon.emotions.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull()))


def pattern_chord(low: Column, lexicon: Lexicon) -> Column:
    """0.5 for each emotion whose pattern matches."""
    entries = F.array(*[F.struct(F.lit(e).alias("k"), F.when(low.rlike(p), 0.5).alias("v")) for e, p in lexicon.patterns.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull()))


def balance(chord_: str, plus: tuple[str, ...], minus: tuple[str, ...]) -> Column:
    """(plus - minus) / (plus + minus) of the chord's weights, two decimals; 0 where there are neither."""
    mass = lambda names: sum((F.coalesce(F.col(chord_)[n], F.lit(0.0)) for n in names), F.lit(0.0))
    p, m = mass(plus), mass(minus)
    return F.when(p + m == 0, 0.0).otherwise(F.round((p - m) / (p + m), 2))


def memory_type(low: Column, lexicon: Lexicon) -> Column:
    out = None
    for name, words in lexicon.types.items():
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out.otherwise("experience")


def spotted(low: Column, names: tuple[str, ...]) -> Column:
    """The names that occur, in the order of the list."""
    return F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda x: F.contains(low, x))


def classified(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with chord, type, people, songs and whether the turn is significant."""
    low = F.lower("text")
    out = turns.withColumn("low", low).withColumn("chord", chord(F.col("low"), lexicon)).withColumn("memory_type", memory_type(F.col("low"), lexicon))
    out = out.withColumn("people", spotted(F.col("low"), lexicon.people)).withColumn("songs", spotted(F.col("low"), lexicon.songs))
    mass = F.aggregate(F.map_values("chord"), F.lit(0.0), lambda s, x: s + x)
    n = F.length("text")
    said = ((mass > 1.5) | (F.col("memory_type") != "experience") | (F.size("people") > 0) | (F.size("songs") > 0)
            | ((F.col("role") == "user") & (n > 200)) | ((F.col("role") == "assistant") & (n > 500) & any_of(F.col("low"), lexicon.phrases)))
    return out.withColumn("significant", (n >= 20) & said).withColumn("valence", balance("chord", lexicon.positive, lexicon.negative)).withColumn("arousal", balance("chord", lexicon.high, lexicon.low))


def by_turn() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def with_context(turns: DataFrame) -> DataFrame:
    """The first hundred characters of the turn before, and the user's turn among the two before."""
    w = by_turn()
    mine = lambda i: F.when(F.lag("role", i).over(w) == "user", F.substring(F.lag("text", i).over(w), 1, 200))
    return turns.withColumn("previous", F.substring(F.lag("text").over(w), 1, 100)).withColumn("asked", F.coalesce(mine(1), mine(2)))


def imported(turns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Significant turns as memories."""
    rows = classified(with_context(turns), lexicon).where("significant")
    user = F.col("role") == "user"
    people = F.when(F.size("people") > 0, F.concat(F.lit("People: "), F.array_join("people", ", ")))
    context = F.concat_ws(" | ", F.concat(F.lit("Conversation: "), F.col("conv_id").cast("string")), F.concat(F.lit("Previous: "), F.when(F.col("previous") != "", F.col("previous"))), people)
    trust = F.create_map(F.lit("trust"), F.lit(0.3))
    return rows.select(
        "conv_id", "turn", F.substring("text", 1, 2000).alias("raw_text"), "memory_type", context.alias("context"), F.when(user, "teaching").otherwise("inference").alias("source_type"),
        F.when(user, "durable").otherwise("provisional").alias("status"), F.when(user, "user").otherwise("assistant").alias("proposed_by"), F.when(F.size(F.map_keys("chord")) > 0, F.col("chord")).otherwise(trust).alias("emotions"),
        "valence", "arousal", F.when(user, 0.8).otherwise(0.5).alias("confidence"), F.col("memory_type").isin(*lexicon.core).alias("is_core"), "people", "songs")


def tagged(memories: DataFrame, rules: dict[tuple[str, str], tuple[str, ...]]) -> DataFrame:
    """Flag and source of untagged rows by the first rule whose words occur; tagged rows keep theirs."""
    tag = None
    for (f, s), words in rules.items():
        pair = F.struct(F.lit(f).alias("flag"), F.lit(s).alias("source"))
        hit = any_of(F.col("_low"), words)
        tag = F.when(hit, pair) if tag is None else tag.when(hit, pair)
    untagged = F.col("pattern_flag").isNull()
    rows = memories.withColumn("_low", F.when(untagged, F.lower("raw_text"))).withColumn("_tag", tag)
    rows = rows.withColumn("new_flag", F.coalesce("pattern_flag", "_tag.flag")).withColumn("new_source", F.when(untagged, F.col("_tag.source")).otherwise(F.col("pattern_source")))
    return rows.drop("_low", "_tag")


def pattern_context(flag: Column, source: Column, templates: dict[str, str]) -> Column:
    """A note by flag; {source} is replaced by " from ..." or nothing."""
    clause = F.coalesce(F.concat(F.lit(" from "), source), F.lit(""))
    out = None
    for name, t in templates.items():
        parts = t.split("{source}")
        text = F.concat(F.lit(parts[0]), clause, F.lit(parts[1])) if len(parts) == 2 else F.lit(t)
        out = F.when(flag == name, text) if out is None else out.when(flag == name, text)
    return out


def chord_text(chord_: str) -> Column:
    """A chord as text, emotions in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(chord_)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(4,2)").cast("string"))), ",")
