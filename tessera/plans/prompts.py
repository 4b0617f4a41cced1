"""Prompts as columns. A template says what is shown (the whole story or not) and what is asked for (reasons or not)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.segments import context_windows, ordered_list


@dataclass(frozen=True)
class Template:
    story: bool
    reasons: bool
    start: str = ">>> "
    end: str = " <<<"
    tagged: bool = False


TEMPLATES = {
    "primary": Template(True, True),
    "primary_no_story": Template(False, True),
    "primary_no_cot": Template(True, False),
    "primary_no_story_no_cot": Template(False, False),
    "secondary": Template(True, True, "<target>", "</target>", True),
}

_TASK = "You align free recall with the text that was recalled. Name every numbered segment whose content the marked part of the recall expresses."
_REASONS = "First say briefly which segments come into question and why."
_ANSWER = "End with the numbers between angle brackets, separated by commas, like <2> or <4, 5>; write <NONE> if no segment fits."
_SEGMENT = "Divide the text into clauses that each say one thing. Copy every clause verbatim, in order, without leaving anything out, and reply with a JSON array of strings only."


def template(name: str | None) -> Template:
    name = name or "primary"
    if name not in TEMPLATES:
        raise ValueError(f"unknown prompt {name!r}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def _part(t: Template, title: str, body: Column) -> list[Column]:
    tag = title.lower().replace(" ", "_")
    return [F.lit(f"<{tag}>\n" if t.tagged else f"{title}:\n"), body, F.lit(f"\n</{tag}>\n\n" if t.tagged else "\n\n")]


def prompt(t: Template, segments: Column, window: Column) -> Column:
    marks = f"The marked part stands between {t.start.strip()} and {t.end.strip()}."
    parts = [F.lit(f"{_TASK} {marks}\n\n")]
    if t.story:
        parts += _part(t, "Full text", text.full_text(segments))
    parts += _part(t, "Numbered segments", text.numbered(segments)) + _part(t, "Recall", window)
    return F.concat(*parts, F.lit(f"{_REASONS} {_ANSWER}" if t.reasons else _ANSWER))


def segmentation_prompt(transcript: Column) -> Column:
    return F.concat(F.lit(_SEGMENT + "\n\n"), text.strip(transcript))


def match_prompts(story: DataFrame, recall: DataFrame, window: int = 5, name: str | None = None, story_key: str = "story_name", keys: tuple[str, ...] = ("sub_id",), idx: str = "recall_idx", story_idx: str = "story_idx") -> DataFrame:
    """story_key, keys, idx, n_story, prompt. A story is one row (its list of segments); recalls meet it on its key."""
    t = template(name)
    stories = ordered_list(story, [story_key], story_idx)
    windows = context_windows(recall, [story_key, *keys], idx, window, t.start, t.end)
    joined = windows.join(stories, story_key)
    return joined.select(story_key, *keys, idx, F.size("segments").alias("n_story"), prompt(t, F.col("segments"), F.col("window")).alias("prompt"))


def estimated_tokens(column: Column | str) -> Column:
    """Without a provider's tokenizer: four characters a token, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(column) / 4)).cast("long")
