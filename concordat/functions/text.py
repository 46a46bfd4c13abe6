"""Column functions over texts and labels; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped around a label; ranges that count as CJK.
LABEL_EDGE = " \t\n\"'“”‘’「」『』[]【】"
CJK = "\\u3000-\\u303f\\u3400-\\u9fff\\uf900-\\ufaff\\uff00-\\uffef"


def clip(text: Column, n: int) -> Column:
    """White space as single blanks, trimmed; cut to n characters and an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def estimate_tokens(text: Column) -> Column:
    """0.7 per CJK character, 0.35 per other one, whole, plus one."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return (F.floor(cjk * 0.7 + (F.length(text) - cjk) * 0.35) + 1).cast("bigint")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def normalize_label(value: Column, labels: list[str]) -> Column:
    """The label a reply means: exact, then ignoring case (the later of equal ones), then the only one it contains."""
    v = F.btrim(value, F.lit(LABEL_EDGE))
    known = F.array(*[F.lit(x) for x in labels])
    same = F.filter(known, lambda x: F.lower(x) == F.lower(v))
    inside = F.filter(known, lambda x: v.contains(x))
    return (
        F.when(F.array_contains(known, v), v)
        .when(F.size(same) > 0, F.element_at(same, -1))
        .when(F.size(inside) == 1, F.element_at(inside, 1))
    )


def reply_fields(reply: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, reason) of a model's reply: its JSON object, or loose patterns where that doesn't parse.

    Thinking sections are dropped; a missing confidence is 0.5, one above 1 a percentage; the result lies in 0..1.
    """
    body = F.regexp_replace(reply, "(?s)<think>.*?</think>", "")
    obj = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    parsed = F.from_json(obj, "label string, confidence string, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = (obj != "") & parsed["_bad"].isNull()
    loose = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit(""))
    label = F.when(good, parsed["label"]).otherwise(loose(r'"label"\s*:\s*"([^"]*)"'))
    number = F.coalesce(F.expr("try_cast(NULL AS double)"), F.when(good, parsed["confidence"]).otherwise(loose(r'"confidence"\s*:\s*"?([0-9.]+)')).try_cast("double"), F.lit(0.5))
    number = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    reason = F.coalesce(F.when(good, parsed["reason"]).otherwise(loose(r'(?s)"reason"\s*:\s*"(.*)"')), F.lit(""))
    return label, F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), reason


def evidence_ok(quote: Column, body: Column) -> Column:
    """Is a quote verbatim: without white space, outer quotes and ellipses, all pieces between ellipses are in the text."""
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    q = F.btrim(flat(quote), F.lit("\"'“”‘’「」『』….。"))
    pieces = F.filter(F.split(q, r"…+|\.{3,}"), lambda p: p != "")
    return (F.length(q) >= 2) & F.forall(pieces, lambda p: flat(body).contains(p))


def token_probability(tokens: Column, text: Column) -> Column:
    """Probability of the label's tokens: exp of the log-probabilities of those that overlap the value of "label".

    ``tokens`` is an array of (t, lp) whose concatenation is ``text``; the last occurrence counts.
    """
    before = F.regexp_extract(text, r'(?s)^(.*"label"\s*:\s*")', 1)
    value = F.regexp_extract(text, r'(?s)^.*"label"\s*:\s*"([^"]*)"', 1)
    lo, hi = F.length(before), F.length(before) + F.length(value)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["t"])
        return F.struct(end.alias("at"), F.when((end > lo) & (acc["at"] < hi), acc["s"] + x["lp"]).otherwise(acc["s"]).alias("s"))

    total = F.aggregate(tokens, start, step, lambda acc: acc["s"])
    return F.when((before != "") & (value != ""), F.round(F.exp(F.greatest(total, F.lit(-50.0))), 4))


def mask_labels(text: Column, labels: list[str], mask: str = "[label]") -> Column:
    """Labels, their parents and leaves, longest first, replaced by a mark."""
    words = {p for x in labels for p in (x, x.split("/", 1)[0], x.rsplit("/", 1)[-1])}
    escape = lambda w: "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}" else c for c in w)
    return F.regexp_replace(text, "|".join(escape(w) for w in sorted(words, key=lambda w: (-len(w), w))), mask)


def chain_hash(*parts: Column) -> Column:
    """Cache key: sha256 over the parts, which keep their borders."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def grouped_order(labels: Column, separator: str = "/") -> Column:
    """Labels of two levels with those of a parent together, where the parent's first one stands; otherwise in their order."""
    parent = lambda x: F.split_part(x, F.lit(separator), F.lit(1))
    parents = F.array_distinct(F.transform(labels, parent))
    return F.flatten(F.transform(parents, lambda p: F.filter(labels, lambda x: parent(x) == p)))


def numbered(items: Column) -> Column:
    """An array of lines as one text, with numbers from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def guide_prompt(task: str, definitions: dict[str, str], order: Column, rules: list[str], examples: Column, opinions: Column, text: Column, clip_at: int = 300) -> Column:
    """A prompt: task, labels in ``order`` with their definitions, rules, examples (array of text, label), other annotators'
    opinions (array of lines), the text and what to answer. Sections without content are left out."""
    known = F.create_map(*[F.lit(x) for pair in definitions.items() for x in pair])
    labels = F.array_join(F.transform(order, lambda x: F.concat(F.lit("## "), x, F.lit("\n"), F.coalesce(F.try_element_at(known, x), F.lit("")))), "\n\n")
    shown = numbered(F.transform(examples, lambda e: F.concat(F.lit("["), e["label"], F.lit("] "), clip(e["text"], clip_at))))
    section = lambda title, body: F.when(body != "", F.concat(F.lit(f"# {title}\n"), body))
    answer = F.concat(F.lit('{"label": "...", "confidence": 0..1, "reason": "..."}\nlabel is one of: '), F.array_join(order, " / "))
    return F.concat_ws(
        "\n\n", section("Task", F.lit(task)), section("Labels", labels), section("Rules", numbered(F.array(*[F.lit(r) for r in rules]).cast("array<string>"))), section("Examples", shown),
        section("Other opinions", F.array_join(opinions, "\n")), section("Text", F.concat(F.lit("<text>\n"), text, F.lit("\n</text>"))), section("Answer", answer),
    )
