"""Strings: model answers, hints, names, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clamp

SCORES = ("sharpness", "exposure", "composition", "expression", "confidence")
NO_FLAGS = "No prior flags."
FAST_MOTION = "Note: directional frequency analysis suggests possible motion blur."


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often use mentions it."""
    return F.transform(F.array(x), use)[0]


def balanced_object(text: Column) -> Column:
    """The first balanced {...} of a text, braces in strings counting too; null if there is none.

    The fold runs over braces, not characters: each step takes the text up to the next brace.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        opens, done, pos = F.endswith(piece, F.lit("{")), s["end"] > 0, s["pos"] + F.length(piece)
        closes = ~opens & (s["depth"] > 0)
        depth = F.when(done, s["depth"]).when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        begin = F.when(~done & opens & (s["depth"] == 0), pos).otherwise(s["start"])
        end = F.when(~done & closes & (s["depth"] == 1), pos).otherwise(s["end"])
        return F.struct(depth.alias("depth"), begin.alias("start"), pos.alias("pos"), end.alias("end"))

    span = F.aggregate(F.regexp_extract_all(text, F.lit("[^{}]*[{}]"), F.lit(0)), start, step)
    return bound(span, lambda x: F.when(x["end"] > 0, F.substring(text, x["start"], x["end"] - x["start"] + 1)))


def cleaned_json(text: Column) -> Column:
    """Single quotes to double ones, trailing commas dropped."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r",\s*\}", "}"), r",\s*\]", "]")


def parse_answer(text: Column) -> Column:
    """struct(is_parse_error, is_keeper, flags, one double per score) of a model's answer.

    The answer must hold an object with a boolean keeper and all scores within 0..1 (numbers, numeric strings or
    booleans); anything else is a parse error with nulls.
    """

    def fields(data: Column) -> Column:
        keeper = F.when(F.schema_of_variant(F.try_variant_get(data, "$.keeper", "variant")) == "BOOLEAN", F.try_variant_get(data, "$.keeper", "boolean"))
        raw = {k: F.coalesce(F.try_variant_get(data, f"$.{k}", "double"), F.try_variant_get(data, f"$.{k}", "boolean").cast("double")) for k in SCORES}
        flags = F.coalesce(F.try_variant_get(data, "$.flags", "array<string>"), F.array().cast("array<string>"))
        return F.struct(keeper.alias("keeper"), flags.alias("flags"), *[x.alias(k) for k, x in raw.items()])

    def judged(x: Column) -> Column:
        ok = x["keeper"].isNotNull()
        for k in SCORES:
            ok = ok & F.coalesce(x[k].between(0.0, 1.0), F.lit(False))
        return F.struct(ok.alias("ok"), x.alias("x"))

    def answer(y: Column) -> Column:
        ok, x = y["ok"], y["x"]
        return F.struct((~ok).alias("is_parse_error"), F.when(ok, x["keeper"]).alias("is_keeper"), F.when(ok, x["flags"]).alias("flags"), *[F.when(ok, x[k]).alias(k) for k in SCORES])

    return bound(F.try_parse_json(cleaned_json(balanced_object(text))), lambda data: bound(fields(data), lambda x: bound(judged(x), answer)))


def parse_explanation(text: Column) -> Column:
    """struct(is_parse_error, explanation, weaknesses, strengths, confidence): the widest {...} must have all four keys."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    data = F.try_parse_json(F.when(found != "", found))
    keys = F.json_object_keys(F.to_json(F.when(F.schema_of_variant(data).startswith("OBJECT"), data)))
    whole = F.coalesce(F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in ("explanation", "weaknesses", "strengths", "confidence")]))) == 4, F.lit(False))
    lists = {k: F.coalesce(F.try_variant_get(data, f"$.{k}", "array<string>"), F.array().cast("array<string>")) for k in ("weaknesses", "strengths")}
    snippet = F.when(F.coalesce(text, F.lit("")) == "", "(empty)").otherwise(F.substring(text, 1, 200))
    said = F.when(whole, F.try_variant_get(data, "$.explanation", "string")).when(data.isNull(), F.concat(F.lit("VLM returned unparseable response: "), snippet))
    said = said.otherwise(F.concat(F.lit("Missing required fields. VLM output: ['"), F.array_join(keys, "', '"), F.lit("']")))
    return F.struct((~whole).alias("is_parse_error"), said.alias("explanation"), *[F.when(whole, x).alias(k) for k, x in lists.items()], F.when(whole, clamp(F.coalesce(F.try_variant_get(data, "$.confidence", "double"), F.lit(0.0)))).alias("confidence"))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def shutter_seconds(text: Column) -> Column:
    """Seconds of "a/bs" or "ns"; null if it reads as neither."""
    whole = F.regexp_extract(text, r"^\s*([0-9.]+)\s*s?\s*$", 1)
    a, b = F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*s?\s*$", 1), F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*s?\s*$", 2)
    return F.when(a != "", F.try_divide(a.try_cast("double"), b.try_cast("double"))).when(whole != "", whole.try_cast("double"))


def shutter_text(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 1, F.concat(numerator.cast("string"), F.lit("s"))).otherwise(F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string"), F.lit("s")))


def aperture_text(value: Column) -> Column:
    return F.format_string("f/%.1f", value)


def _lines(*lines: Column) -> Column:
    shown = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return F.when(F.size(shown) == 0, NO_FLAGS).otherwise(F.array_join(shown, "\n"))


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def prompt_hints(composite: Column, composition: Column, motion: Column, is_bokeh: Column, has_face: Column, emotion: Column, closed: Column, occluded: Column, highlight: Column, shadow: Column, cast: Column) -> Column:
    """The lines a scoring prompt opens with, in fixed order."""
    # Fixed texts of the prompt.
    return _lines(
        F.when(composite.isNotNull(), F.concat(F.lit("Note: Stage 2 composite score was "), _two(composite), F.lit("."))),
        F.when(composition.isNotNull(), F.concat(F.lit("Note: prior composition analysis scored "), _two(composition), F.lit("."))),
        F.when(motion, FAST_MOTION),
        F.when(is_bokeh, "Note: shallow depth of field may be intentional; judge subject sharpness without rewarding a weak frame overall."),
        F.when(has_face, "Note: a face was detected in the frame."),
        F.when(F.coalesce(emotion, F.lit("")) != "", F.concat(F.lit("Note: expression classifier detected '"), emotion, F.lit("'."))),
        F.when(closed, "Note: eye closure was detected — verify if subject's eyes are open."),
        F.when(occluded, "Note: face occlusion was detected — verify if the subject is obstructed."),
        F.when(highlight, "Note: highlight clipping detected in prior exposure analysis."),
        F.when(shadow, "Note: shadow clipping detected in prior exposure analysis."),
        F.when(cast, "Note: color cast detected in prior exposure analysis."),
    )


def explain_hints(motion: Column, is_bokeh: Column, highlight: Column, shadow: Column, cast: Column, noise: Column, composite: Column) -> Column:
    # Fixed texts of the prompt.
    return _lines(
        F.when(motion, "Motion blur detected."),
        F.when(is_bokeh, "Bokeh (intentional background blur) detected."),
        F.when(highlight, "Highlight clipping detected."),
        F.when(shadow, "Shadow clipping detected."),
        F.when(cast, "Color cast detected."),
        F.when(noise > 0, F.concat(F.lit("Noise score: "), _two(noise), F.lit("."))),
        F.when(composite.isNotNull(), F.concat(F.lit("Stage 2 composite IQA score: "), _two(composite), F.lit("."))),
    )


def pair_hints(label: str, motion: Column, emotion: Column, closed: Column, highlight: Column, shadow: Column, cast: Column) -> Column:
    """The lines on one photo of a pair; empty if there are none."""
    had = lambda what: f"Note: {label} had {what} in prior analysis."
    shown = F.array(
        F.when(motion, had("motion blur")), F.when(F.coalesce(emotion, F.lit("")) != "", F.concat(F.lit(f"Note: {label} expression classifier detected '"), emotion, F.lit("'."))),
        F.when(closed, had("eye closure")), F.when(highlight, had("highlight clipping")), F.when(shadow, had("shadow clipping")), F.when(cast, had("color cast")),
    )
    return F.array_join(F.filter(shown, lambda x: x.isNotNull()), "\n")


def outlier_flags(palette: Column, exposure: Column, exif: Column) -> Column:
    """Names of the shoot statistics over one half, "none", or a dash without statistics."""
    shown = F.filter(F.array(F.when(palette > 0.5, "palette"), F.when(exposure > 0.5, "exposure"), F.when(exif > 0.5, "exif")), lambda x: x.isNotNull())
    return F.when(F.coalesce(palette, exposure, exif).isNull(), "—").when(F.size(shown) == 0, "none").otherwise(F.array_join(shown, ", "))


# The mark of each label in a strip of decisions.
MARKS = {"keeper": "\u25cf", "rejected": "\u25cb", "uncertain": "\u25d0", "duplicate": "\u25cc", "select": "\u2605", "KEEPER": "\u25cf", "REJECT": "\u25cb", "AMBIGUOUS": "\u25d0"}


def film_strip(labels: Column) -> Column:
    """One mark per label of an array, in order; unknown labels are marked as uncertain."""
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    return F.array_join(F.transform(labels, lambda x: F.coalesce(marks[x], F.lit(MARKS["uncertain"]))), "")


def byte_text(n: Column, largest: str = "GB") -> Column:
    """A number of bytes in the unit that suits it, but none above `largest` (KB, MB or GB); halves go to the even digit, a
    null stays null."""
    kb, mb, gb = float(1 << 10), float(1 << 20), float(1 << 30)
    units = {"KB": F.format_string("%.0f KB", F.rint(n / kb)), "MB": F.format_string("%.1f MB", F.bround(n / mb, 1)), "GB": F.format_string("%.2f GB", F.bround(n / gb, 2))}
    text = F.when(n < kb, F.format_string("%d B", n))
    for unit, most in (("KB", mb), ("MB", gb))[: list(units).index(largest)]:
        text = text.when(n < most, units[unit])
    return text.when(n.isNotNull(), units[largest])


def duration_text(seconds: Column) -> Column:
    short = F.when(seconds < 60, F.format_string("%.0fs", F.rint(seconds.cast("double"))))
    return short.when(seconds >= 60, F.format_string("%dm%02ds", F.floor(seconds / 60), F.floor(seconds % 60)))
