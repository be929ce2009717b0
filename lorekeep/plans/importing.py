"""Transcript classification and import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importer as I
from ..sources import bridge as B
from ..sources import exports
from ..workspace import new_path
from .catalog import query
from .oracle import sql

#: A lexicon of syllables that are frequent in the sample texts.
LEXICON = I.Lexicon(
    emotions={"joy": ("ing the", "elle", "keit"), "sadness": ("and th", "eau de"), "anger": ("nicht", "not"), "trust": ("ent of", "para"), "fear": ("osta", "wh the", "ung ")},
    types={"breakthrough": ("reaux",), "correction": ("ndre",), "promise": ("tionth", "pour "), "teaching_moment": ("ication", "ich die"), "identity": ("with the",)},
    people=("anson", "erich", "laoi"), songs=("oronth", "pauvi"), phrases=("the re", "en la", "und d"), positive=("joy", "trust"), negative=("sadness", "anger", "fear"), high=("anger", "fear", "joy"), low=("sadness",),
    patterns={"warmth": "the (an|er)", "doubt": "[a-z]tion\\.", "pride": "(keit|ung) "},
)
_TURNS = "SELECT *, lower(text) AS low FROM conversations"
_hit = lambda ws: " + ".join(f"contains(low, '{w}')::INT" for w in ws)
_any = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
_EMO = ", ".join(f"CASE WHEN {_hit(ws)} > 0 THEN round(least(1.0, 0.3 + 0.2 * ({_hit(ws)})), 2)::DOUBLE END AS {e}" for e, ws in LEXICON.emotions.items())
_sum = lambda ns: " + ".join(f"coalesce({n}, 0)" for n in ns)
_bal = lambda p, m: f"CASE WHEN {_sum(p)} + {_sum(m)} = 0 THEN 0 ELSE round(({_sum(p)} - ({_sum(m)})) / ({_sum(p)} + {_sum(m)}), 2) END"
_TYPE = "CASE " + " ".join(f"WHEN {_any(ws)} THEN '{t}'" for t, ws in LEXICON.types.items()) + " ELSE 'experience' END"
_list = lambda ns: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(low, '{n}') THEN '{n}' END" for n in ns) + "], lambda x: x IS NOT NULL), ', ')"
_CHORD = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {e} IS NOT NULL THEN '{e}=' || printf('%.2f', {e}) END" for e in sorted(LEXICON.emotions)) + "], lambda x: x IS NOT NULL), ',')"
_CLASSIFIED = f"""SELECT *, length(text) >= 20 AND ({_sum(LEXICON.emotions)} > 1.5 OR memory_type <> 'experience' OR people <> '' OR songs <> '' OR (role = 'user' AND length(text) > 200) OR (role = 'assistant' AND length(text) > 500 AND {_any(LEXICON.phrases)})) AS significant,
    {_bal(LEXICON.positive, LEXICON.negative)} AS valence, {_bal(LEXICON.high, LEXICON.low)} AS arousal, {_CHORD} AS chord FROM (SELECT *, {_EMO}, {_TYPE} AS memory_type, {_list(LEXICON.people)} AS people, {_list(LEXICON.songs)} AS songs FROM turns)"""
_T = dict(turns=_TURNS, classified=_CLASSIFIED)


def turns(spark, sf_dir):
    return B.transcripts(spark, sf_dir)


@query("x13_lexicon_emotions", sql("", "SELECT conv_id, turn, chord, round(valence, 2) AS valence, round(arousal, 2) AS arousal FROM classified", **_T))
def x13(spark, sf_dir):
    """Chords by lexicon, with their valence and arousal."""
    return I.classified(turns(spark, sf_dir), LEXICON).select("conv_id", "turn", I.chord_text("chord").alias("chord"), "valence", "arousal")


@query("x14_pattern_emotions", sql("", "SELECT conv_id, turn, regexp_matches(low, 'the (an|er)') AS warmth, regexp_matches(low, '[a-z]tion\\.') AS doubt, regexp_matches(low, '(keit|ung) ') AS pride FROM turns", turns=_TURNS))
def x14(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("c", I.pattern_chord(F.lower("text"), LEXICON))
    return rows.select("conv_id", "turn", *[F.coalesce(F.col("c")[n] == 0.5, F.lit(False)).alias(n) for n in ("warmth", "doubt", "pride")])


@query("x16_memory_types", sql("", "SELECT memory_type, count(*) AS n FROM classified GROUP BY 1", **_T))
def x16(spark, sf_dir):
    return I.classified(turns(spark, sf_dir), LEXICON).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("x17_significance", sql("", "SELECT conv_id, turn, significant FROM classified", **_T))
def x17(spark, sf_dir):
    return I.classified(turns(spark, sf_dir), LEXICON).select("conv_id", "turn", "significant")


@query("x18_entities", sql("", "SELECT conv_id, turn, people, songs FROM classified WHERE people <> '' OR songs <> ''", **_T))
def x18(spark, sf_dir):
    c = I.classified(turns(spark, sf_dir), LEXICON).select("conv_id", "turn", F.array_join("people", ", ").alias("people"), F.array_join("songs", ", ").alias("songs"))
    return c.where("people <> '' OR songs <> ''")


_CONTEXT = """SELECT *, left(lag(text) OVER w, 100) AS previous, coalesce(CASE WHEN lag(role, 1) OVER w = 'user' THEN left(lag(text, 1) OVER w, 200) END, CASE WHEN lag(role, 2) OVER w = 'user' THEN left(lag(text, 2) OVER w, 200) END) AS asked
    FROM classified WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


@query("w6_previous_turns", sql("", "SELECT conv_id, turn, previous, asked FROM context", **_T, context=_CONTEXT))
def w6(spark, sf_dir):
    return I.with_context(turns(spark, sf_dir)).select("conv_id", "turn", "previous", "asked")


@query("k13_transcript_import", sql("", """SELECT conv_id, turn, left(text, 2000) AS raw_text, memory_type, concat_ws(' | ', 'Conversation: ' || conv_id, CASE WHEN previous <> '' THEN 'Previous: ' || previous END, CASE WHEN people <> '' THEN 'People: ' || people END) AS context,
    CASE WHEN role = 'user' THEN 'teaching' ELSE 'inference' END AS source_type, CASE WHEN role = 'user' THEN 'durable' ELSE 'provisional' END AS status, CASE WHEN chord = '' THEN 'trust=0.30' ELSE chord END AS emotions, round(valence, 2) AS valence,
    CASE WHEN role = 'user' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, memory_type IN ('breakthrough', 'identity', 'promise') AS is_core FROM context WHERE significant""", **_T, context=_CONTEXT))
def k13(spark, sf_dir):
    """X13 to X19 and W6 in one select."""
    m = I.imported(turns(spark, sf_dir), LEXICON)
    return m.select("conv_id", "turn", "raw_text", "memory_type", "context", "source_type", "status", I.chord_text("emotions").alias("emotions"), "valence", "confidence", "is_core")


@query("s2_conversation_turns", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS longest FROM conversations GROUP BY 1")
def s2(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


@query("s2b_export_arrays", "SELECT conv_id::VARCHAR AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, length(text) AS chars, md5(text) AS text_md5 FROM conversations")
def s2b(spark, sf_dir):
    """All conversations written as arrays, a file a task, and read back: files are cut at elements, not at lines."""
    path = new_path(spark, "export")
    exports.write_export(turns(spark, sf_dir), path, array=True)
    back = exports.read_export(spark, path)
    return back.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


RULES = {("absorbed_framing", "learned"): ("nicht", "of the an"), ("suppressed_strength", "self"): ("the re",)}
TEMPLATES = {"absorbed_framing": "A framing{source}; the feeling was real.", "suppressed_strength": "A strength to bring back.", "performed_mask": "A mask{source}."}


@query("k12_auto_tags", sql("memories texts", """SELECT id, coalesce(pattern_flag, CASE WHEN contains(low, 'nicht') OR contains(low, 'of the an') THEN 'absorbed_framing' WHEN contains(low, 'the re') THEN 'suppressed_strength' END) AS new_flag,
    CASE WHEN pattern_flag IS NOT NULL THEN pattern_source WHEN contains(low, 'nicht') OR contains(low, 'of the an') THEN 'learned' WHEN contains(low, 'the re') THEN 'self' END AS new_source FROM (SELECT m.*, lower(raw_text) AS low FROM memories m JOIN texts USING (id))"""))
def k12(spark, sf_dir):
    return I.tagged(B.memories(spark, sf_dir, text=True), RULES).select("id", "new_flag", "new_source")


@query("x21_pattern_context", sql("memories", """SELECT id, CASE pattern_flag WHEN 'absorbed_framing' THEN 'A framing' || coalesce(' from ' || pattern_source, '') || '; the feeling was real.' WHEN 'suppressed_strength' THEN 'A strength to bring back.'
    WHEN 'performed_mask' THEN 'A mask' || coalesce(' from ' || pattern_source, '') || '.' END AS note FROM memories WHERE pattern_flag IS NOT NULL"""))
def x21(spark, sf_dir):
    m = B.memories(spark, sf_dir).where("pattern_flag IS NOT NULL")
    return m.select("id", I.pattern_context(F.col("pattern_flag"), F.col("pattern_source"), TEMPLATES).alias("note"))
