"""Parsing and formatting as columns: scores, model output, names and dates in file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a name that mark a secret.
SECRETS = ("TOKEN", "SECRET", "PASSWORD", "KEY", "CREDENTIAL")
#: Keys by which a score and its reasons are given.
SCORE_KEYS = ("score", "rating", "value", "level", "label")
REASON_KEYS = ("rationale", "reasoning", "explanation", "justification", "justificativa", "reason", "evaluation", "assessment")
#: What the synthesized predicate is called in Portuguese.
PARTICIPATION = {"is participated by": "envolve"}
TRUE_WORDS = ("true", "yes", "1", "sim")
#: Date patterns in the order they are tried (dashed, written, dotted).
DATES = (r"\b(\d{2}-\d{2}-\d{2,4})(?=\D|$)", r"(?i)\b(\d{1,2} de [a-zç]{3,4}\.?)", r"\b(\d{2}\.\d{2})\b")


def clamp_score(value: Column) -> Column:
    """A number held within 0 and 1; 0.5 for what isn't one."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def clamp_ordinal(value: Column, low: int = 1, high: int = 5, default: int = 3) -> Column:
    """A whole number held within the scale; the default for what isn't one, or has a fraction."""
    v = value.try_cast("double")
    whole = F.when(v == F.floor(v), v).otherwise(float(default))
    return F.least(F.greatest(F.coalesce(whole, F.lit(float(default))), F.lit(float(low))), F.lit(float(high))).cast("int")


def round_half_up(value: Column, low: int = 1, high: int = 5) -> Column:
    """The nearest whole number, halves up; null off the scale."""
    v = F.floor(value.try_cast("double") + 0.5).cast("int")
    return F.when(v.between(low, high), v)


def thinking(text: Column) -> Column:
    """The contents of all think blocks, a line break between them; null without any."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    return F.nullif(F.array_join(F.transform(found, lambda x: F.trim(x)), "\n"), F.lit(""))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", " "))


def without_fence(text: Column) -> Column:
    """The content of a code fence, if the text starts with one."""
    t = F.trim(text)
    return F.when(F.startswith(t, F.lit("```")), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))).otherwise(t)


def model_json(text: Column) -> Column:
    """struct(score, rationale) of an object in a model's answer, under any of their keys."""
    body = without_fence(without_thinking(text))
    get = lambda k: F.get_json_object(body, f"$.{k}")
    return F.struct(F.coalesce(*map(get, SCORE_KEYS)).try_cast("double").alias("score"), F.coalesce(*map(get, REASON_KEYS)).alias("rationale"))


def reasoning(text: Column, most: int = 3) -> Column:
    """struct(is_multi_hop, hop_count); the count holds only for several hops, between 1 and `most`."""
    multi = F.coalesce(F.lower(F.get_json_object(text, "$.is_multi_hop")).isin(*TRUE_WORDS), F.lit(False))
    hops = F.get_json_object(text, "$.hop_count").try_cast("int")
    return F.struct(multi.alias("is_multi_hop"), F.when(multi & hops.between(1, most), hops).alias("hop_count"))


def question_type(level: Column) -> Column:
    """Remembering asks for facts, the levels above for concepts; unknown levels count as the first."""
    return F.when(level.isin("understand", "apply", "analyze", "evaluate", "create"), "conceptual").otherwise("factual")


def safe_name(text: Column, colon: str = "_") -> Column:
    return F.replace(F.replace(text, F.lit(":"), F.lit(colon)), F.lit("/"), F.lit("_"))


def redacted(env: Column) -> Column:
    """A map whose values are masked where the name speaks of a secret."""
    secret = "(?i)" + "|".join(SECRETS)
    return F.transform_values(env, lambda k, v: F.when(F.rlike(k, F.lit(secret)), "***").otherwise(v))


def header(fields: list[tuple[str, Column]], marker: str = "---") -> Column:
    """Labelled lines of the fields that aren't empty, and a marker; empty if none is."""
    lines = F.filter(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in fields)), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit(f"\n{marker}\n"))).otherwise(F.lit(""))


def without_header(text: Column, marker: str = "---") -> Column:
    at = F.instr(text, F.lit(f"{marker}\n"))
    return F.when(at > 0, F.substring(text, at + len(marker) + 1, F.length(text))).otherwise(text)


def passages_block(passages: Column, none: str = "(no passages)") -> Column:
    """Numbered passages, an empty line between them."""
    body = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit("]: "), p)), "\n\n")
    return F.when(F.size(passages) == 0, none).otherwise(body)


def triple(head: Column, head_type: Column, relation: Column, tail: Column, tail_type: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(head_type, F.lit("?")), F.lit("] "), head, F.lit(" --["), F.coalesce(relation, F.lit("related_to")), F.lit("]--> ["), F.coalesce(tail_type, F.lit("?")), F.lit("] "), tail)


def relabelled(relation: Column, language: Column, names: dict[str, str]) -> Column:
    """Predicates with their name in Portuguese, for that language only."""
    out = relation
    for old, new in names.items():
        out = F.when((language == "pt") & (relation == old), new).otherwise(out)
    return out


def sanitized(segments: Column) -> Column:
    """Segments with numbers for times: 0 for a missing start, the start for a missing end, and no end before it."""
    start = lambda s: F.coalesce(s["start"].try_cast("double"), F.lit(0.0))
    end = lambda s: F.greatest(start(s), F.coalesce(s["end"].try_cast("double"), start(s)))
    return F.transform(segments, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), start(s).alias("start"), end(s).alias("end")))


def date_in(text: Column) -> Column:
    """The first date: dashed ones first, then written, then dotted."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DATES))


def known(text: Column, names: dict[str, str]) -> Column:
    """The name whose key the text is, or the longest key it contains, in any case; BarraDoSul counts as Barra Do Sul too."""
    t, apart = F.lower(F.trim(text)), F.lower(F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " "))
    exact = [((t == k) | (apart == k), v) for k, v in names.items()]
    inside = [(F.contains(t, F.lit(k)) | F.contains(apart, F.lit(k)), v) for k, v in sorted(names.items(), key=lambda x: (-len(x[0]), x[0]))]
    out = F.lit(None).cast("string")
    for condition, value in reversed(exact + inside):
        out = F.when(condition, value).otherwise(out)
    return out


def person(text: Column, names: dict[str, str]) -> Column:
    """The person whose key the text is or starts with, or who is called by a key that starts with it (four letters at least)."""
    t = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    loose = [((F.startswith(F.lit(k), t) & (F.length(t) >= 4)) | F.startswith(t, F.lit(k)), v) for k, v in names.items()]
    for condition, value in reversed([(t == k, v) for k, v in names.items()] + loose):
        out = F.when(condition, value).otherwise(out)
    return out


def clean_name(name: Column) -> Column:
    """A person's name without trailing numbers and marks around it; null for what holds digits or, of several words, a lower-case one."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^[ \-_,.]+|[ \-_,.]+$", ""), r"(?U)\s+\d+$", "")
    bare = F.regexp_replace(bare, r"[ \-_,.]+$", "")
    parts = F.split(bare, r"(?U)\s+")
    small = F.exists(parts, lambda w: (F.length(w) > 2) & ~F.startswith(w, F.lit("D.")) & F.rlike(w, F.lit(r"^\p{Ll}")))
    return F.when((bare != "") & ~F.rlike(bare, F.lit(r"(?U)\d")) & ((F.size(parts) == 1) | ~small), bare)


def from_file_name(name: Column, people: dict[str, str], places: dict[str, str]) -> Column:
    """struct(device, date, sequence_label, sequence_number, researcher, location, participant) of a recording's name.

    A device in brackets, names cameras give (nothing else in them), video timestamps, part labels, trailing numbers
    and dates are taken off in turn; what is left is split at underscores, or else at dashes, and matched with known
    people and places; the first other piece is the participant, but of two such pieces between dashes the first is the
    researcher where none is known.
    """
    none, empty = F.lit(None).cast("string"), F.lit("")
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    device = F.nullif(F.regexp_extract(stem, r"^\[([^\]]+)\]", 1), empty)
    stem = F.regexp_replace(stem, r"^\[[^\]]+\]", "")
    camera = F.rlike(name, F.lit(r"(?i)^(MVI_\d+|IMG_\d+|_MG_\d+|DSC_\d+)\.\w+$"))
    video = F.rlike(name, F.lit(r"^VID_\d{8}_"))
    part = lambda i: F.regexp_extract(name, r"^VID_(\d{4})(\d{2})(\d{2})_", i)
    video_date = F.concat_ws("-", part(3), part(2), part(1))
    label = F.nullif(F.regexp_extract(stem, r"(?i)(Parte\s+[IVX]+)", 1), empty)
    stem = F.regexp_replace(stem, r"(?is)\s*Parte\s+[IVX]+.*$", "")
    number = F.nullif(F.regexp_extract(stem, r"[\s_\-]+(\d{1,2})\s*$", 1), empty)
    stem = F.when(number.isNotNull(), F.regexp_replace(F.regexp_replace(stem, r"[\s_\-]+\d{1,2}\s*$", ""), r"[\s_\-]+$", "")).otherwise(stem)
    date = date_in(stem)
    stem = F.when(date.isNotNull(), F.regexp_replace(F.replace(stem, date, empty), r"^[\s_\-]+|[\s_\-]+$", "")).otherwise(stem)
    dashes = ~F.contains(stem, F.lit("_"))
    pieces = F.when(dashes, F.split(stem, r"\s*-\s*")).otherwise(F.split(stem, "_"))
    pieces = F.transform(pieces, lambda p: F.trim(p))
    dashed = r"^\d{2}-\d{2}-\d{2,4}$"  # after an underscore, where no word begins, a date is a piece of its own
    date = F.coalesce(date, F.get(F.filter(pieces, lambda p: F.rlike(p, F.lit(dashed))), F.lit(0)))
    pieces = F.filter(pieces, lambda p: ~F.rlike(p, F.lit(dashed)) & (p != "") & ~F.rlike(p, F.lit(r"^\d+$")) & (F.size(F.split(p, r"\s+")) <= 4))
    who, where = F.transform(pieces, lambda p: person(p, people)), F.transform(pieces, lambda p: known(p, places))
    rest = F.filter(pieces, lambda p: person(p, people).isNull() & known(p, places).isNull())
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    two = dashes & first(who).isNull() & (F.size(rest) > 1)
    researcher, participant = F.when(two, F.get(rest, F.lit(0))).otherwise(first(who)), F.get(rest, F.when(two, 1).otherwise(0))
    plain = ~camera & ~video
    only = lambda c: F.when(plain, c).otherwise(none)
    sequence = F.when(video, F.nullif(F.regexp_extract(stem, r"~(\d+)", 1), empty)).when(plain, number)
    return F.struct(device.alias("device"), F.when(video, video_date).when(plain, date).alias("date"), only(label).alias("sequence_label"), sequence.alias("sequence_number"), only(researcher).alias("researcher"), only(first(where)).alias("location"), only(participant).alias("participant"))


def from_path(path: Column, root: str, people: dict[str, str], places: dict[str, str]) -> Column:
    """struct(location, event_context, researcher, date, participant) of folders below the media root."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda p: F.contains(p, F.lit(root))), F.lit(True))
    folder = F.when(at > 0, F.get(parts, at.cast("int")))
    location = known(F.regexp_replace(folder, r"(?i)\s*[-–]\s*Fotos.*$", ""), places)
    below = F.when(at > 0, F.filter(F.slice(parts, at.cast("int") + 2, F.greatest(F.size(parts) - at.cast("int") - 1, F.lit(0))), lambda p: ~F.rlike(p, F.lit(r"\.\w{2,4}$")) & ~F.upper(F.trim(p)).isin("AUDIOS", "VÍDEOS", "FOTOS") & (F.trim(p) != "")))
    context = F.trim(F.get(below, F.lit(0)))
    bracket = person(F.nullif(F.regexp_extract(context, r"^\[([^\]]+)\]", 1), F.lit("")), people)
    guest = F.nullif(F.trim(F.regexp_extract(context, r"(?i)^Entrevista\s+(.+?)\s+\d{2}-\d{2}", 1)), F.lit(""))
    return F.struct(location.alias("location"), context.alias("event_context"), bracket.alias("researcher"), date_in(context).alias("date"), guest.alias("participant"))


def confidence(*fields: Column) -> Column:
    """The share of four fields that are filled, to two places."""
    return F.bround(sum(F.when(f.isNotNull(), 1).otherwise(0) for f in fields) / 4.0, 2)
