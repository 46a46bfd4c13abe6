"""Dialogues and documents as items: turns, sessions, blocks, chapters, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role names by meaning; patterns of speakers, headings and noise lines; tone words.
ROLES = {"user": "user", "customer": "user", "client": "user", "用户": "user", "客户": "user", "顾客": "user", "agent": "agent", "assistant": "agent", "service": "agent", "客服": "agent", "坐席": "agent", "商家": "agent", "system": "system", "系统": "system"}
SPEAKER = r"^\s*([^：:\n]{1,16})[：:]\s*(.*)$"
HEADING = r"^(第[一二三四五六七八九十百零0-9]{1,4}[章节部分篇]|[一二三四五六七八九十]{1,3}、.{1,24}|\d{1,2}[\.、]\s*\S{1,24})$"
HEADING_WORD = "节|章|风险|讨论与分析|社会责任|公司治理|重要事项|财务报告"
NOISE = r"\.{5,}|…{2,}|⋯{2,}|本公司董事会|^第?\d{1,4}页$|^目录$"
POSITIVE, NEGATIVE = "积极|正面|机遇|看多|positive", "消极|负面|风险|看空|negative"


def role(name: Column) -> Column:
    """Known roles by their meaning, others unchanged, empty ones ``unknown``."""
    t = F.trim(F.coalesce(name, F.lit("")))
    out = F.when(t == "", "unknown").otherwise(t)
    for k, v in ROLES.items():
        out = F.when(F.lower(t) == k, v).otherwise(out)
    return out


def sessions(turns: DataFrame, max_chars: int = 6000) -> DataFrame:
    """One row per session of ``turns(session_id, seq, role, text, time, label)``.

    Turns are ordered by time (as text) if all of a session have one, else by seq; the longest run of last turns
    within ``max_chars`` stays, at least one; a label counts if it is the only one of the session.
    """
    s = Window.partitionBy("session_id")
    t = turns.where(F.trim("text") != "").withColumn("timed", F.bool_and(F.col("time").isNotNull()).over(s))
    t = t.withColumn("key", F.when(F.col("timed"), F.col("time")).otherwise(F.lit("")))
    back = s.orderBy(F.desc("key"), F.desc("seq"))
    t = t.withColumn("used", F.sum(F.length("text") + F.length("role") + 2).over(back)).withColumn("rn", F.row_number().over(back))
    t = t.withColumn("kept", (F.col("used") <= max_chars) | (F.col("rn") == 1))
    line = F.struct("key", "seq", F.concat_ws(": ", "role", "text").alias("line"))
    out = t.groupBy("session_id").agg(
        F.count("*").alias("n_turns"), F.count_if(~F.col("kept")).alias("omitted"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), line))).alias("lines"), F.collect_set("label").alias("labels"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return out.select("session_id", "n_turns", "omitted", text.alias("text"), F.when(F.size("labels") == 1, F.element_at("labels", 1)).alias("label"))


def turn_items(turns: DataFrame, context: int = 6, roles: list[str] | None = None) -> DataFrame:
    """One row per turn with the turns before it as context; the context is taken before roles are filtered."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-context, -1)
    t = turns.withColumn("context", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(before), "\n"))
    return t.where(F.col("role").isin(roles)) if roles else t


def transcript_turns(texts: DataFrame) -> DataFrame:
    """(id, turn, role, text) from ``texts(id, text)`` in lines ``role: words``; other lines go on with the turn before."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    words = F.trim(F.regexp_extract("line", SPEAKER, 2))
    lines = lines.withColumn("starts", words != "")
    w = Window.partitionBy("id").orderBy("pos")
    lines = lines.withColumn("turn", F.greatest(F.sum(F.col("starts").cast("int")).over(w), F.lit(1)))
    head = F.when(F.col("starts"), role(F.regexp_extract("line", SPEAKER, 1)))
    part = F.struct("pos", F.when(F.col("starts"), words).otherwise(F.col("line")).alias("t"))
    g = lines.groupBy("id", "turn").agg(F.max(head).alias("role"), F.array_sort(F.collect_list(part)).alias("p"))
    return g.select("id", F.col("turn").cast("int").alias("turn"), F.coalesce("role", F.lit("text")).alias("role"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def cited(text: Column, reasons: Column) -> Column:
    """Does a reason quote eight characters in a row of a turn (a shorter turn: all of it)."""
    starts = F.when(F.length(text) >= 8, F.sequence(F.lit(0), F.length(text) - 8, F.lit(8)))
    return F.when(F.length(text) < 8, (text != "") & reasons.contains(text)).otherwise(F.exists(starts, lambda i: reasons.contains(F.substr(text, i + 1, F.lit(8)))))


def clean(text: Column) -> Column:
    """Trimmed non-empty lines, joined by a blank, or by nothing if half of the text is CJK."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cjk = F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]", ""))
    return F.when(cjk * 2 >= F.greatest(F.length(text), F.lit(1)), F.array_join(lines, "")).otherwise(F.array_join(lines, " "))


def is_heading(line: Column) -> Column:
    t = F.trim(line)
    fits = (t != "") & (F.length(t) <= 40) & ~t.rlike("[。！？；]$")
    return fits & (t.rlike(HEADING) | ((F.length(t) <= 24) & t.rlike(HEADING_WORD)))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc, pos, text): parts of ``docs(doc, text)`` between blank lines."""
    b = docs.select("doc", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "text"))
    return b.where(F.trim("text") != "")


def repeated_lines(b: DataFrame, pages: int = 3, max_len: int = 30) -> DataFrame:
    """(doc, flat): short blocks that stand on several pages of a document, running headers mostly."""
    flat = F.regexp_replace("text", r"\s+", "")
    return b.where(F.length("text") <= max_len).groupBy("doc", flat.alias("flat")).agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages).select("doc", "flat")


def paragraphs(b: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc, n, chapter, page, text) of ``b(doc, pos, page, text, heading)``: headings carried forward, noise dropped."""
    noise = repeated_lines(b.select("doc", "page", "text")).groupBy("doc").agg(F.collect_set("flat").alias("noise"))
    first = F.trim(F.regexp_extract("text", r"^\s*([^\n]*)", 1))
    rest = F.regexp_replace("text", r"^\s*[^\n]*\n?", "")
    b = b.repartition("doc")  # the only time that texts are moved: the windows and the join are by doc
    b = b.withColumn("first", first).withColumn("head", F.col("heading") | is_heading(F.col("first")))
    w = Window.partitionBy("doc").orderBy("pos")
    b = b.withColumn("chapter", F.coalesce(F.last(F.when(F.col("head"), F.left("first", F.lit(40))), True).over(w), F.lit("(opening)")))
    b = b.withColumn("body", F.when(F.col("head"), clean(rest)).otherwise(clean(F.col("text"))))
    flat = F.regexp_replace("body", r"\s+", "")
    kept = b.where((F.length("body") >= min_chars) & ~flat.rlike(NOISE)).join(noise, "doc", "left")
    kept = kept.where(~F.coalesce(F.array_contains("noise", flat), F.lit(False)))
    return kept.select("doc", F.row_number().over(w).alias("n"), "chapter", "page", F.col("body").alias("text"))


def neighbours(p: DataFrame, n: int = 160) -> DataFrame:
    """``prev`` and ``next`` of the paragraphs that are left, cut to n characters."""
    w = Window.partitionBy("doc").orderBy("n")
    side = lambda f: F.coalesce(F.left(f("text").over(w), F.lit(n)), F.lit(""))
    return p.withColumn("prev", side(F.lag)).withColumn("next", side(F.lead))


#: Merging of scanned lines (fixed values): least score, gap in line heights and at least in points, least height, first height.
SCORE, GAP_HEIGHTS, GAP, HEIGHT, FIRST_HEIGHT = 0.5, 0.8, 10.0, 8.0, 16.0


def merged_lines(lines: DataFrame) -> DataFrame:
    """(page, n, text): paragraphs of recognised ``lines(page, top, bottom, left, text, score)``.

    Lines go from top to bottom, then by bottom, left and text; one that begins lower than the line before ends by more than
    a share of that line's height begins a paragraph. Blank and doubtful lines are left out, a null score counts as sure;
    n counts paragraphs that have text after cleaning, from 1.
    """
    kept = lines.where((F.trim("text") != "") & (F.coalesce("score", F.lit(1.0)) >= SCORE)).withColumn("text", F.trim("text"))
    w = Window.partitionBy("page").orderBy("top", "bottom", "left", "text")
    height = F.greatest(F.coalesce(F.lag(F.col("bottom") - F.col("top")).over(w), F.lit(FIRST_HEIGHT)), F.lit(HEIGHT))
    far = F.coalesce(F.col("top") - F.lag("bottom").over(w) > F.greatest(height * GAP_HEIGHTS, F.lit(GAP)), F.lit(False))
    kept = kept.withColumn("far", far.cast("int")).withColumn("part", F.sum("far").over(w)).withColumn("at", F.row_number().over(w))
    parts = kept.groupBy("page", "part").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    parts = parts.select("page", "part", clean(F.array_join(F.transform("x", lambda x: x["text"]), "")).alias("text")).where("text <> ''")
    return parts.select("page", F.row_number().over(Window.partitionBy("page").orderBy("part")).alias("n"), "text")
