"""Calls of an annotator: cache, batches, failures and replies that can't be read."""

import os

from concordat.operators import annotator


def own():
    def talking(settings):
        folder = settings["folder"]

        def one(prompt):
            text = prompt.partition("\nText: ")[2]
            return {"odd": "no idea", "other": '{"label": "C"}', "think": '<think>{"label": "B"}</think>{"label": "a", "confidence": 80}'}.get(text, '{"label": "B", "confidence": 0.5, "reason": "r"}')

        def chat(prompts):
            with open(f"{folder}/calls", "a") as f:
                f.write("".join(p.partition("\nText: ")[2] + "\n" for p in prompts))
            if any("broken" in p for p in prompts):
                raise RuntimeError("refused")
            return [one(p) for p in prompts]

        return chat

    return talking


def lines(path):
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


def test_annotate(spark, tmp_path):
    annotator.register("talking", own())
    settings, cache = {"folder": str(tmp_path)}, f"file://{tmp_path}/cache"
    items = spark.createDataFrame([(1, "x"), (2, "odd"), (3, "other"), (4, "think"), (5, "x"), (6, None), (None, "y")], "item_id long, text string")
    got = {r["item_id"]: tuple(r)[1:] for r in annotator.annotate(items, ["A", "B"], cache, "talking", settings).collect()}
    assert got[1] == got[5] == got[6] == got[None] == ("B", 0.5, "r", None)
    assert got[4][:2] == ("A", 0.8) and got[2][3] == got[3][3] == "no label" and got[2][0] is None
    assert sorted(lines(f"{tmp_path}/calls")) == ["", "odd", "other", "think", "x", "y"]
    again = annotator.annotate(items, ["A", "B"], cache, "talking", settings)
    assert again.count() == 7 and len(lines(f"{tmp_path}/calls")) == 6
    failed = spark.createDataFrame([(8, "broken")], "item_id long, text string")
    assert tuple(annotator.annotate(failed, ["A", "B"], cache, "talking", settings).first()) == (8, None, None, None, "no reply")
    assert len(lines(f"{tmp_path}/calls")) == 9
    assert annotator.annotate(items.limit(0), ["A", "B"], cache, "talking", settings).count() == 0
