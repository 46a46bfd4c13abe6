"""Queries that reshape dialogues, documents and pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape
from ..sources.tables import table
from .registry import query

_ROLE = "CASE lower(trim(role)) WHEN '' THEN 'unknown' WHEN 'user' THEN 'user' WHEN 'customer' THEN 'user' WHEN 'client' THEN 'user' WHEN 'agent' THEN 'agent' WHEN 'assistant' THEN 'agent' WHEN 'service' THEN 'agent' WHEN 'system' THEN 'system' ELSE trim(role) END"
TURNS_SQL = f"tu AS (SELECT conv_id AS session_id, turn AS seq, {_ROLE} AS role, text, CASE WHEN conv_id % 2 = 0 THEN CAST(turn * 3 % 8 AS varchar) END AS time, CASE WHEN conv_id % 3 = 0 THEN 'a' WHEN conv_id % 3 = 1 AND turn = 0 THEN 'b' WHEN conv_id % 3 = 1 THEN 'c' END AS label FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns, half of the sessions with times (as text, out of order)."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") % 3
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), reshape.role(F.col("role")).alias("role"), "text",
        F.when(F.col("conv_id") % 2 == 0, (F.col("turn") * 3 % 8).cast("string")).alias("time"),
        F.when(k == 0, "a").when((k == 1) & (F.col("turn") == 0), "b").when(k == 1, "c").alias("label"),
    )


@query(f"""WITH {TURNS_SQL}, t AS (SELECT *, CASE WHEN bool_and(time IS NOT NULL) OVER (PARTITION BY session_id) THEN time ELSE '' END AS key FROM tu WHERE trim(text) <> ''),
u AS (SELECT *, sum(length(text) + length(role) + 2) OVER (PARTITION BY session_id ORDER BY key DESC, seq DESC) AS used, row_number() OVER (PARTITION BY session_id ORDER BY key DESC, seq DESC) AS rn FROM t)
SELECT session_id, count(*) AS n_turns, count(*) FILTER (WHERE NOT (used <= 800 OR rn = 1)) AS omitted,
  string_agg(concat(role, ': ', text), chr(10) ORDER BY key, seq) FILTER (WHERE used <= 800 OR rn = 1) AS text, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label FROM u GROUP BY session_id""")
def dialogue_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.sessions(turns(spark, sf_dir), 800)


@query(f"""WITH {TURNS_SQL}, c AS (SELECT session_id, seq, role, text, coalesce((SELECT string_agg(concat(p.role, ': ', p.text), chr(10) ORDER BY p.seq) FROM tu p WHERE p.session_id = t.session_id AND p.seq < t.seq AND p.seq >= t.seq - 3), '') AS context FROM tu t)
SELECT * FROM c WHERE role = 'agent'""")
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.turn_items(turns(spark, sf_dir), 3, ["agent"]).select("session_id", "seq", "role", "text", "context")


@query(f"""WITH {TURNS_SQL}, x AS (SELECT session_id, seq, replace(replace(text, ':', ' '), '：', ' ') AS t, role FROM tu),
y AS (SELECT session_id, seq, role, string_split(t, chr(10)) AS l FROM x)
SELECT session_id AS id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS int) AS turn, role, array_to_string(list_filter(list_transform(l, lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS text FROM y""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcripts and parsed back."""
    t = turns(spark, sf_dir).select("session_id", "seq", F.concat_ws(": ", "role", F.translate("text", ":：", "  ")).alias("line"))
    t = t.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return reshape.transcript_turns(t.select("id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")))


@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id AS doc, CAST(pos AS int) AS pos, trim(line) AS text FROM b WHERE trim(line) <> ''""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of texts; the tables have single line ends, so lines stand for blocks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return reshape.blocks(d).select("doc", "pos", F.trim("text").alias("text"))


_BLOCKS_SQL = """bl AS (SELECT doc_id AS doc, CAST(pos AS int) AS pos, CAST(pos // 2 + 1 AS int) AS page, trim(line) AS text, length(trim(line)) <= 30 AS heading FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line) <> '')"""
_PARA_SQL = f"""{_BLOCKS_SQL},
ch AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '(opening)') AS chapter FROM bl),
para AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS int) AS n, chapter, page, text FROM ch WHERE NOT heading AND length(text) >= 20)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, two to a page, short ones as headings."""
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    return b.withColumn("page", (F.floor(F.col("pos") / 2) + 1).cast("int")).withColumn("heading", F.length("text") <= 30)


@query(f"WITH {_PARA_SQL} SELECT * FROM para")
def chapter_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.paragraphs(_blocks(spark, sf_dir))


@query(f"""WITH {_BLOCKS_SQL} SELECT doc, regexp_replace(text, '\\s+', '', 'g') AS flat FROM bl WHERE length(text) <= 30 GROUP BY ALL HAVING count(DISTINCT page) >= 3""")
def doc_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.repeated_lines(_blocks(spark, sf_dir))


_CHOSEN_SQL = f"{_PARA_SQL}, chosen AS (SELECT * FROM para WHERE contains(lower(text), 'tion') OR contains(lower(text), 'que'))"


@query(f"WITH {_CHOSEN_SQL} SELECT * FROM chosen")
def paragraph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return chapter_fill(spark, sf_dir).where(low.contains("tion") | low.contains("que"))


@query(f"WITH {_CHOSEN_SQL} SELECT doc, n, chapter, page, text, coalesce(left(lag(text) OVER w, 160), '') AS prev, coalesce(left(lead(text) OVER w, 160), '') AS next FROM chosen WINDOW w AS (PARTITION BY doc ORDER BY n)")
def paragraph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.neighbours(paragraph_filter(spark, sf_dir))


@query("""SELECT source AS doc, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality = 0) AS negative,
  round(CAST(count(*) FILTER (WHERE quality = 1) AS double) / count(*), 6) AS positive_share, round(CAST(count(*) FILTER (WHERE quality = 0) AS double) / count(*), 6) AS negative_share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, and count and share of each label, by document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lab = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    p = d.groupBy(F.coalesce("source", F.lit("(none)")).alias("doc"), lab.alias("label")).agg(F.count("*").alias("n"))
    g = p.groupBy("doc").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x) for x in ("positive", "negative")])
    return g.withColumns({f"{x}_share": F.round(F.col(x) / F.col("n"), 6) for x in ("positive", "negative")})


@query("""SELECT source AS doc, round(CAST(count(*) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 0) AS double) / count(*), 6) AS net_tone FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def doc_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(positive - negative) / paragraphs; labels count by the tone words in their names."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lab = F.when(F.col("quality") == 1, "positive news").when(F.col("quality") == 0, "negative news")
    sign = F.when(lab.rlike(reshape.POSITIVE), 1).when(lab.rlike(reshape.NEGATIVE), -1).otherwise(0)
    return d.groupBy(F.col("source").alias("doc")).agg(F.round(F.sum(sign) / F.count("*"), 6).alias("net_tone"))


@query(f"""WITH {TURNS_SQL}, r AS (SELECT session_id, string_agg(substr(text, 5, 40), chr(10) ORDER BY seq) AS reasons FROM tu WHERE seq % 2 = 0 GROUP BY session_id)
SELECT session_id, seq, CASE WHEN length(text) < 8 THEN text <> '' AND contains(reasons, text) ELSE len(list_filter(range(0, length(text) - 7, 8), lambda i: contains(reasons, substr(text, CAST(i AS int) + 1, 8)))) > 0 END AS cited FROM tu JOIN r USING (session_id)""")
def cited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    r = t.where("seq % 2 = 0").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("text", 5, 40).alias("t")))).alias("r"))
    r = r.select("session_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("reasons"))
    return t.join(r, "session_id").select("session_id", "seq", reshape.cited(F.col("text"), F.col("reasons")).alias("cited"))


class _Blocks(HTMLParser):
    """Text between closing block tags; scripts and styles left out. Broken markup never fails: a marked section is a comment
    up to the next ``>``, and an open comment takes the rest of the page."""

    FLUSH = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "br", "tr"))

    def __init__(self):
        super().__init__()
        self.out, self.buffer, self.mute, self.ending = [], [], 0, False

    def close(self) -> None:
        self.ending = True
        super().close()
        self.flush(False)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self._past(">", i + 3)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._past("-->", i + 4)

    def _past(self, mark: str, i: int) -> int:
        at = self.rawdata.find(mark, i)
        if at < 0:
            return len(self.rawdata) if self.ending else -1
        return at + len(mark)

    def flush(self, heading: bool) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.out.append((text, heading))
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag in self.FLUSH:
            self.flush(tag[0] == "h")

    def handle_data(self, data):
        if not self.mute:
            self.buffer.append(data)


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages; HTML needs a parser, which runs in Arrow batches. A page's rows leave before the next is parsed."""
    names = ["page_id", "pos", "text", "heading"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, html in zip(b.column("page_id"), b.column("html"), strict=True):
                p = _Blocks()
                p.feed(html.as_py() or "")
                p.close()
                n = len(p.out)
                columns = [pa.array([page.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in p.out], pa.string()), pa.array([h for _, h in p.out], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id bigint, pos int, text string, heading boolean")


_LINES_SQL = """ln AS (SELECT doc_id AS page, i, trim(t) AS t, 30.0 * i + CASE WHEN len(t) % 3 = 0 THEN 14 ELSE 0 END AS top, 30.0 * i + 16 + len(t) % 12 AS bottom, CASE WHEN len(t) % 11 = 0 THEN 0.4 ELSE 0.9 END AS score
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""


@query(f"""WITH {_LINES_SQL}, k AS (SELECT *, lag(bottom) OVER w AS pb, greatest(coalesce(lag(bottom - top) OVER w, 16.0), 8.0) AS ph FROM ln WHERE t <> '' AND score >= 0.5 WINDOW w AS (PARTITION BY page ORDER BY top, bottom, t)),
s AS (SELECT *, sum(CASE WHEN top - pb > greatest(ph * 0.8, 10.0) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, bottom, t) AS part FROM k)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY part) AS int) AS n, lines FROM (SELECT page, part, count(*) AS lines FROM s GROUP BY page, part)""")
def scan_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents set out on pages as a scanner would give them, merged to paragraphs; each one's number of lines."""
    at = F.posexplode(F.split("text", "\n")).alias("i", "t")
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page"), at)
    n = F.length("t")
    top, bottom = 30.0 * F.col("i") + F.when(n % 3 == 0, 14).otherwise(0), 30.0 * F.col("i") + 16 + n % 12
    lines = t.select("page", top.alias("top"), bottom.alias("bottom"), F.lit(0.0).alias("left"), F.when(F.trim("t") != "", F.concat(F.regexp_replace(F.trim("t"), "(?s).+", "x"), F.lit(""))).otherwise("").alias("text"), F.when(n % 11 == 0, 0.4).otherwise(0.9).alias("score"))
    return reshape.merged_lines(lines).select("page", "n", F.length("text").cast("bigint").alias("lines"))
