"""What a model is asked: the scoring prompt of one photograph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys an answer must have, and the flags it may name.
FIELDS = ("sharpness", "exposure", "composition", "expression", "keeper", "confidence", "flags")
FLAGS = ("motion_blur", "defocus", "overexposed", "underexposed", "eyes_closed", "bad_expression", "no_clear_subject", "cluttered", "color_cast", "noise", "tilted_horizon", "edge_cropped_subject")

#: What counts most under each preset.
INTENT = {
    "general": "Weigh technique, composition and the strength of the subject evenly; mood does not make up for faults.",
    "wedding": "Expressions, open eyes, kind light and feeling come first; faults of technique still cost.",
    "documentary": "The moment and a subject that reads clearly come first; grave faults are not forgiven.",
    "wildlife": "A sharp subject, good timing and a clear background come first.",
    "landscape": "Sharpness to the edges, exposure, a level horizon and strong composition come first.",
    "street": "The decisive moment and its framing come first; plain blur, clipping and clutter are rejected.",
    "holiday": "People, atmosphere and story count alike; weak technique is still rejected.",
}


def scoring_prompt(preset: Column | str, hints: Column) -> Column:
    """The whole prompt: intent of the preset (unknown or null: general), hints, and what to answer."""
    name = F.lit(preset) if isinstance(preset, str) else preset
    intent = F.lit(INTENT["general"])
    for k, v in INTENT.items():
        intent = F.when(F.lower(name) == k, v).otherwise(intent)
    ask = (
        "Answer with one JSON object and nothing else, from { to }, with all of these keys:\n"
        '"sharpness", "exposure", "composition", "expression", "confidence": numbers from 0.0 to 1.0 (expression is 0.5 where nobody is seen)\n'
        '"keeper": true or false\n'
        f'"flags": a list of any of {", ".join(FLAGS)}\n'
        'For instance: {"sharpness": 0.9, "exposure": 0.8, "composition": 0.75, "expression": 0.5, "keeper": true, "confidence": 0.85, "flags": []}'
    )
    return F.concat(F.lit("You judge the quality of a photograph.\n\nIntent:\n"), intent, F.lit("\n\nKnown so far:\n"), hints, F.lit("\n\n" + ask))


def explain_prompt(label: Column, hints: Column) -> Column:
    """The whole prompt for why a photograph was judged as it was: the label, hints, and what to answer."""
    ask = (
        "Answer with one JSON object and nothing else, from { to }, with all of these keys:\n"
        '"explanation": two or three sentences\n'
        '"weaknesses", "strengths": lists of short phrases, empty if there are none\n'
        '"confidence": a number from 0.0 to 1.0'
    )
    return F.concat(F.lit("You explain the quality of a photograph that was judged: "), label, F.lit(".\n\nKnown so far:\n"), F.coalesce(hints, F.lit("")), F.lit("\n\n" + ask))
