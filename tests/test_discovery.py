"""Job arrays in nested JSON, JSON-LD and aliases: pinned cases, and random trees against a walk in plain Python."""

from __future__ import annotations

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.sources import discovery as d

JOBS = [{"title": "Engineer", "url": "/a"}, {"title": "Analyst", "url": "/b"}, {"title": "Clerk", "url": "/c"}]


def pages(spark, *htmls: str):
    return spark.createDataFrame([(i, "https://a.example/jobs?x=1", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def rows(frame) -> dict:
    out: dict = {}
    for r in sorted(frame.collect(), key=lambda r: (r.page_id, r.place)):
        out.setdefault(r.page_id, []).append((r.source, r.title, r.url, r.location))
    return out


def next_block(data) -> str:
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script></html>'


def ordered_walk(node, path=()):
    """Candidates as (length, path) by the survey's rule, members in the order of keys."""
    if isinstance(node, list):
        objects = [x for x in node if isinstance(x, dict)]
        if len(node) >= 2 and len(objects) >= 2 and len(objects) * 10 >= len(node) * 8:
            if Counter(frozenset(o) for o in objects).most_common(1)[0][1] * 10 >= len(objects) * 8:
                like = [o for o in objects if any(re.search("title", k, re.I) for k in o) and any(re.search("url|slug|path", k, re.I) for k in o)]
                if like and len(like) * 10 >= len(node) * 7:
                    yield -len(like), path, like
                    return
        inner = node
    elif isinstance(node, dict):
        inner = [node[k] for k in sorted(node)]
    else:
        return
    for i, x in enumerate(inner):
        yield from ordered_walk(x, (*path, i))


def test_the_largest_job_array_is_found_at_any_depth(spark):
    deep = JOBS
    for i in range(25):
        deep = {"k": deep, "n": i} if i % 2 else [deep, i]
    menu = [{"title": "Home", "path": "/"}, {"title": "Us", "path": "/us"}]
    mixed = [*JOBS, *JOBS, 5]  # six objects of seven elements
    got = rows(d.embedded_jobs(d.blocks(pages(spark, next_block({"x": menu, "y": {"z": JOBS}}), next_block(deep), next_block({"a": JOBS[:1]}), next_block([*JOBS, 1]), next_block(mixed), next_block([JOBS, menu])))))
    found = [("next", j["title"], "https://a.example" + j["url"], None) for j in JOBS]
    assert got == {0: found, 1: found, 4: found * 2, 5: found}  # one object, or three of four elements, are no list


def test_kinds_of_blocks_and_which_comes_first(spark):
    text = json.dumps({"jobs": JOBS[:2]})
    htmls = [
        f"<script>window.__NUXT__={text};</script>", f"<script>var a=1; window.__APOLLO_STATE__ =\n {text} ;\n</script>", f"<SCRIPT type='application/json' data-x>{text}</SCRIPT>",
        f'<script type="application/json">{json.dumps({"a": [{"title": "q", "url": "/q"}] * 3})}</script><script>__NUXT__ = {text}</script>',
        '<script type="application/json">{broken</script>', f"<script>__NUXT__(function(){{}})</script><p>{text}</p>", "", f"<script type=text/x>{text}</script>",
    ]
    got = rows(d.embedded_jobs(d.blocks(pages(spark, *htmls))))
    assert {k: (v[0][0], len(v)) for k, v in got.items()} == {0: ("nuxt", 2), 1: ("apollo", 2), 2: ("generic", 2), 3: ("nuxt", 2)}
    none = pages(spark, "x").withColumn("html", F.lit(None).cast("string"))
    assert d.embedded_jobs(d.blocks(none)).count() == 0 and d.linked_jobs(d.blocks(none)).count() == 0
    assert d.embedded_jobs(d.blocks(none.filter("false"))).count() == 0


def test_fields_of_found_objects(spark):
    jobs = [{"title": "", "subTitle": "B", "url": "mailto:x", "pathName": "/p", "cityName": "Oslo"}, {"title": 5, "subTitle": "C", "url": "https://b.example/c", "pathName": 1, "cityName": ["x"]}, {"title": None, "subTitle": None, "url": "", "pathName": "", "cityName": ""}]
    assert rows(d.embedded_jobs(d.blocks(pages(spark, next_block(jobs))))) == {0: [("next", "B", "https://a.example/p", "Oslo"), ("next", "C", "https://b.example/c", None)]}


def test_random_trees_against_the_plain_walk(spark):
    draw = random.Random(11)

    def tree(depth: int):
        roll = draw.random()
        if roll < 0.3 and depth > 1:
            keys = draw.sample(("title", "url", "slug", "x", "jobTitle"), draw.randrange(1, 4))
            items = [{k: f"{k}{draw.randrange(9)}" for k in (keys if draw.random() < 0.9 else ["x"])} for _ in range(draw.randrange(6))]
            return items + [draw.randrange(3) for _ in range(draw.random() < 0.2)]
        if roll < 0.65 and depth < 6:
            return [tree(depth + 1) for _ in range(draw.randrange(4))]
        if depth < 6:
            return {k: tree(depth + 1) for k in draw.sample("abcdef", draw.randrange(1, 4))}
        return draw.choice((None, 1, "t"))

    trees = [[tree(0), tree(0)] for _ in range(150)]
    want = {}
    for i, t in enumerate(trees):
        best = min(ordered_walk(t), default=None, key=lambda c: c[:2])
        if best:
            want[i] = len(best[2]), sorted(str(sorted(o.items())) for o in best[2])
    assert len(want) > 20
    arrays = d._walked(d.blocks(pages(spark, *map(next_block, trees))), d.job_like, d.children, 3)
    best = arrays.groupBy("page_id").agg(F.min_by("got", F.struct(-F.size("got"), "path")).alias("g"))
    objects = best.select("page_id", F.transform("g", lambda m: F.to_json(m)).alias("g")).collect()
    assert {r.page_id: (len(r.g), sorted(str(sorted(json.loads(o).items())) for o in r.g)) for r in objects} == want


def test_linked_data(spark):
    place = {"@type": "Place", "address": {"addressLocality": " ", "addressRegion": "TG", "addressCountry": "IN"}}
    posting = lambda t, **more: {"@type": "JobPosting", "title": t, **more}
    data = [
        posting("A", url="/a", jobLocation=" Hyderabad, India "),
        {"@type": "ItemList", "itemListElement": [posting("B", jobLocation=[place, {"address": "Main St"}, {}]), {"@type": "ListItem", "item": posting("hidden")}]},
        {"@context": "x", "@graph": [{"@type": "Organization"}, posting("C", jobLocation={"name": "HQ"}), [posting("D")]]},
        {"other": posting("unreached")}, posting(""),
    ]
    html = "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in data)
    got = rows(d.linked_jobs(d.blocks(pages(spark, html))))
    assert got == {0: [("linked", "A", "/a", "Hyderabad, India"), ("linked", "B", None, "TG | Main St"), ("linked", "C", None, "HQ"), ("linked", "D", None, None)]}


def test_payload_shapes_and_aliases(spark):
    cases = {
        '[{"title": "x"}]': 1, '[1, {"title": "x"}]': None, "[]": None, '{"jobs": []}': 0, '{"jobs": 3, "items": [1, 2]}': 2, '{"results": {"hits": [1]}}': 1,
        '{"body": {"body": {"jobs": [1]}}}': None, '{"records": [1], "positions": [1, 2]}': 2, "3": None, "{bad": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "j string").withColumn("a", d.payload_jobs(F.try_parse_json("j")))
    assert {r.j: None if r.a is None else len(r.a) for r in frame.collect()} == cases
    titles = {'{"name": "n", "text": "t"}': "t", '{"title": "", "job_title": "j"}': "j", '{"title": 0, "role": ["x"]}': '["x"]', '{"title": false, "position": 2}': "2", "{}": None, "[1]": None}
    frame = spark.createDataFrame([(k,) for k in titles], "j string").withColumn("t", d.field(F.try_parse_json("j"), d.TITLE_FIELDS))
    assert {r.j: r.t for r in frame.collect()} == titles
