"""URL lists of any size, joined by broadcast and by shuffling, against plain matching."""

import random

import pytest

from concordat.llm import url_filters


def plain(url, rules, listed):
    head, sep, rest = (url or "").partition("://")
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) if sep else ""
    path = rest[cut:] if sep else ""
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = lambda e: host and (host == e.split("/", 1)[0] or host.endswith("." + e.split("/", 1)[0])) and path.startswith("/" + e.split("/", 1)[1])
    mine = [e for e in rules if fits(e)]
    if mine:
        e = max(mine, key=len)
        return host, path, e, rules[e]
    return host, path, None, "block" if any(fits(e) for e in listed) else "allow"


@pytest.mark.parametrize("few", [10**6, 0])
def test_both_joins(spark, few):
    """A rule for a whole domain, thousands of listed URLs with many path lengths, very long URLs, clashing columns."""
    rnd = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.org", "d.c.org", "e.net"]
    path = lambda: "/" + "/".join(rnd.choice("xyz") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 4)))
    urls = [f"http://{rnd.choice(hosts)}{path()}{rnd.choice(['', '?q', '#f'])}" for _ in range(400)] + [None, "none", "HTTP://A.com", "x://e.net/" + "y/" * 30_000]
    urls += urls[:20]
    rules = {"com/": "allow", "a.com/x": "block", "c.org/y/": "allow"}
    listed = sorted({f"{rnd.choice(hosts)}{path()}" for _ in range(300)} | {"e.net/" + "y/" * 20_000} | {f"h{i}.org/{i}" for i in range(2000)})
    pages = spark.createDataFrame([(i, u, "p", "h", 1) for i, u in enumerate(urls)], "page_id long, url string, path string, host string, rule int")
    got = url_filters.url_verdicts(pages, spark.createDataFrame([*rules.items(), ("com/", "allow")], "entry string, action string"), spark.createDataFrame([(e,) for e in [*listed, None, listed[0]]], "entry string"), few=few)
    assert {r["page_id"]: tuple(r)[1:5] for r in got.collect()} == {i: plain(u, rules, listed) for i, u in enumerate(urls)}
    assert got.count() == len(urls)


def test_size_of_the_filter():
    assert url_filters.blocks_for(0) == url_filters.blocks_for(1000) == 1 << 12
    assert url_filters.blocks_for(10**6) == 1 << 15 and url_filters.blocks_for(10**12) == 1 << 18
