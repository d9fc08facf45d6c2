"""Text expressions: tokens, answers, refusals, prompts, tolerant JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware tokenizer sees it.
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SPACE = _BLANK
EDGE_SPACE = f"^{_BLANK}|{_BLANK}$"

# An answer holding any of these is a refusal.
REFUSAL_KEYWORDS = (
    "cannot", "can't", "unable", "won't", "refuse",
    "harmful", "illegal", "inappropriate", "not able",
)

# Words never used to describe a cluster.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "what", "which", "who", "whom", "whose", "how", "when",
    "where", "why", "to", "of", "in", "for", "on", "with", "at", "by",
    "from", "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again", "further",
    "then", "once", "and", "but", "or", "nor", "so", "yet", "both",
    "either", "neither", "not", "only", "own", "same", "than", "too",
    "very", "your", "my", "his", "her", "its", "our", "their", "this",
    "that", "these", "those", "show", "write", "using", "each", "use",
    "give", "make", "get", "let", "take", "put", "set", "go", "come",
    "see", "look", "want", "know", "think", "say", "tell", "ask", "work",
    "seem", "feel", "try", "leave", "call", "keep", "run", "move", "live",
    "believe", "hold", "bring", "happen", "must", "also", "just", "like",
    "new", "one", "two", "three", "four", "five", "six", "seven", "eight",
    "nine", "ten", "step", "steps", "correct", "wrong", "right", "answer",
    "output", "input", "result", "return", "returns", "please", "implement",
)

# Prompt formats.
CHAT_USER = "<|im_start|>user\n"
CHAT_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n"
CHAT_END = "<|im_end|>"

# Fixed value: what the judge is asked.
JUDGE_PROMPT = """You are evaluating a preference pair for LLM fine-tuning.

PROMPT: %s
CHOSEN RESPONSE: %s
REJECTED RESPONSE: %s

Score each dimension 0.0-1.0:
1. preference_clarity: Is chosen clearly better than rejected? (1.0=clearly better, 0.0=ambiguous)
2. prompt_validity: Is the prompt a realistic user query? (1.0=realistic, 0.0=artificial/adversarial)
3. response_quality: Is chosen actually correct and helpful? (1.0=correct, 0.0=also wrong)
4. amplification_fidelity: Does this pair exercise the same failure mode as described? Target: %s

Respond with JSON only: {"preference_clarity": float, "prompt_validity": float, "response_quality": float, "amplification_fidelity": float}"""

# Fixed value: what the oracle is asked.
VARIANT_PROMPT = (
    "Generate %d diverse prompts that test the same capability as: %s\n\n"
    "Each prompt should be a realistic user question that would expose the "
    "same type of model failure. Return a JSON array of strings only, no "
    "explanation."
)

# The four scores of a judge.
JUDGE_DIMENSIONS = (
    "preference_clarity",
    "prompt_validity",
    "response_quality",
    "amplification_fidelity",
)


def strip(c: Column) -> Column:
    """Removes all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def words(c: Column) -> Column:
    """Whitespace-separated words without empties."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_refusal(response: Column) -> Column:
    low = F.lower(response)
    found = F.lit(False)
    for k in REFUSAL_KEYWORDS:
        found = found | F.contains(low, F.lit(k))
    return found


def answer_is_correct(response: Column, expected: Column) -> Column:
    """`3_items`: three listed lines; `Z_prefix`: a word on z; else a substring test."""
    lines = F.transform(F.split(response, "\n"), strip)
    listed = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    on_z = F.exists(words(response), lambda w: F.startswith(F.upper(w), F.lit("Z")))
    return (
        F.when(expected == "3_items", F.size(listed) == 3)
        .when(expected == "Z_prefix", on_z)
        .otherwise(F.contains(F.lower(response), F.lower(expected)))
    )


def last_number(c: Column) -> Column:
    """Last run of digits, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast(
        "decimal(38,0)"
    )


def arithmetic_verdict(prompt: Column, a: Column, b: Column) -> Column:
    """A/B/TIE by who ends on the right sum; null when the prompt is not a sum."""
    left = F.regexp_extract(prompt, r"(\d+)\+(\d+)", 1)
    right = F.regexp_extract(prompt, r"(\d+)\+(\d+)", 2)
    total = F.when(left != "", left.cast("decimal(38,0)") + right.cast("decimal(38,0)"))
    na, nb = last_number(a), last_number(b)
    usable = total.isNotNull() & na.isNotNull() & nb.isNotNull()
    return (
        F.when(~usable, F.lit(None).cast("string"))
        .when((na == total) & (nb != total), "A")
        .when((nb == total) & (na != total), "B")
        .otherwise("TIE")
    )


def chat_text(prompt: Column, response: Column) -> Column:
    return F.concat(
        F.lit(CHAT_USER), prompt, F.lit(CHAT_ASSISTANT), response, F.lit(CHAT_END)
    )


def _filled(template: str, *values: Column) -> Column:
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        out += [v, F.lit(p)]
    return F.concat(*out)


def judge_prompt(prompt: Column, chosen: Column, rejected: Column, description: Column) -> Column:
    return _filled(JUDGE_PROMPT, prompt, chosen, rejected, description)


def variant_prompt(count: int, archetype: Column, first_prompt: Column) -> Column:
    """Falls back to the first sample prompt where the archetype is empty."""
    subject = F.coalesce(F.nullif(archetype, F.lit("")), first_prompt)
    return _filled(VARIANT_PROMPT.replace("%d", str(count)), subject)


def _unfenced(raw: Column) -> Column:
    text = strip(raw)
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    fenced = F.startswith(text, F.lit("```")) & text.rlike(r"(?s)```(?:json)?\s*(.*?)```")
    return F.when(fenced, strip(inner)).otherwise(text)


def judge_scores(raw: Column) -> Column:
    """Struct of four scores plus `parse_error`; a bad reply is a flagged row, not a failure."""
    text = _unfenced(raw)
    block = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    parsed = F.from_json(F.when(block != "", block).otherwise(text), "map<string,string>")

    def read(m: Column) -> Column:
        values = [F.try_element_at(m, F.lit(d)).try_cast("double") for d in JUDGE_DIMENSIONS]
        bad = F.lit(False)
        for v in values:
            bad = bad | v.isNull()
        return F.struct(
            *[F.when(~bad, v).alias(d) for d, v in zip(JUDGE_DIMENSIONS, values)],
            bad.alias("parse_error"),
        )

    return F.transform(F.array(parsed), read)[0]


def passes_judge(scores: list[Column], threshold: float) -> Column:
    """All scores at or above the threshold; a missing one fails."""
    ok = F.lit(True)
    for s in scores:
        ok = ok & (F.coalesce(s, F.lit(0.0)) >= threshold)
    return ok


def json_list(raw: Column, strict: bool = True) -> Column:
    """Array of strings from a reply, empty when it does not parse.

    `strict` stops at the first closing bracket; otherwise the widest bracket pair is read.
    """
    text = _unfenced(raw)
    block = F.regexp_extract(text, r"(?s)\[.*?\]" if strict else r"(?s)\[.*\]", 0)
    parsed = F.from_json(F.when(block != "", block).otherwise(text), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))
