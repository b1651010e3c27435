"""Crawls against plain Python, one session and page after the other."""

import random

import pytest

from quillmesh.operators import frontier as R
from quillmesh.operators.frontier import Budget

WORDS = {"chapters": 2.2, "chapter": 2.0, "news": -0.8, "map": 1.8, "staff": -0.7}


def url(k, host="x.org"):
    return f"https://{host}/p{k}"


def plain_score(link, anchor, depth, page, rich, source_host):
    text = (link.split("/", 3)[3] + " " + (anchor or "")).lower()
    same = 1.0 if link.split("/")[2] == source_host else -3.0
    return round(same + sum(w for k, w in WORDS.items() if k in text) + (0.6 if page[2] else 0.0) + min(page[3] or 0, 4) * 0.15 + 0.2 + (0.4 if rich else 0.0) - 0.45 * depth, 4)


def plain_crawl(sessions, pages, links, b):
    by, out, visits = {p[0]: p for p in pages}, {}, []
    for sid, source, seeds in sessions:
        queue, seen = {}, []
        for n, u in enumerate(seeds or []):
            if u in by:
                queue.setdefault(u, [5.0, 0, (0, n)])
        n_pages = records = streak = 0
        last = None
        while True:
            left = {u: q for u, q in queue.items() if u not in seen}
            reason = (
                "page_budget_exhausted" if b.pages and n_pages >= b.pages else "frontier_empty" if not left else "empty_streak_exhausted" if b.empty and streak >= b.empty
                else "high_yield_saturated" if b.records and records >= b.records and n_pages >= 2 and streak >= 1 else "saturation_reached" if b.saturation and streak >= b.saturation
                else "min_score_floor" if last is not None and last < b.score else None
            )
            if reason is None:
                u, (score, depth, _) = min(left.items(), key=lambda x: (-x[1][0], x[1][1], x[1][2], x[0]))
                reason = "min_score_floor" if score < b.score else None
            if reason:
                out[sid] = (reason, n_pages, records, streak)
                break
            got = by[u][1] or 0
            seen.append(u)
            n_pages, records, last, streak = n_pages + 1, records + got, score, 0 if got else streak + 1
            visits.append((sid, n_pages, u, score, depth, got))
            place = 0
            if depth < b.depth:
                for _, link, anchor in sorted((o, x, a) for at, o, x, a in links if at == u):
                    if link not in by or link.split("/")[2].split(".")[-2:] != source.split("/")[2].split(".")[-2:]:
                        continue
                    s = plain_score(link, anchor, depth + 1, by[u], got > 0, source.split("/")[2])
                    if s < b.score or place >= (max(2, min(b.links, b.links_of_rich)) if got else b.links):
                        continue
                    place += 1
                    if link in queue:
                        queue[link][0] = max(queue[link][0], s)
                    else:
                        queue[link] = [s, depth + 1, (n_pages, place)]
    return out, sorted(visits)


SESSION, PAGE, LINK = "session_id int, source_url string, seeds array<string>", "url string, records long, has_map boolean, repeated int", "at string, ordinal int, link string, anchor string"


def both(spark, tmp_path, sessions, pages, links, b):
    visits, stops = R.crawl(spark.createDataFrame(sessions, SESSION), spark.createDataFrame(pages, PAGE), spark.createDataFrame(links, LINK), b, str(tmp_path / "crawl"))
    want, steps = plain_crawl(sessions, pages, links, b)
    assert {r[0]: tuple(r[1:]) for r in stops.collect()} == want
    assert sorted(map(tuple, visits.collect())) == steps
    return {w[0] for w in want.values()}


@pytest.mark.parametrize("budget", [Budget(pages=4, empty=0, saturation=0), Budget(pages=6, depth=2, links=3, empty=3, saturation=0, records=6), Budget(pages=0, depth=1, saturation=2, score=0.9)])
def test_crawls(spark, tmp_path, budget):
    draw = random.Random(7)
    host = lambda: draw.choice(["x.org"] * 6 + ["www.x.org", "y.org"])
    pages = list({u: (u, draw.choice([0, 0, 1, 4, None]), draw.choice([True, False, None]), draw.choice([None, 0, 2, 6])) for u in (url(k, host()) for k in range(60))}.values())
    links = [(p[0], n, draw.choice(pages)[0] if draw.random() < 0.9 else "https://x.org/nowhere", draw.choice([None, "chapter map", "our chapters", "news of staff", "x"])) for p in pages for n in range(draw.randrange(7))]
    sessions = [(i, f"https://{host()}/", [draw.choice(pages)[0] for _ in range(draw.randrange(4))]) for i in range(25)] + [(98, "https://x.org", None), (99, "https://x.org", ["https://x.org/nowhere"])]
    assert len(both(spark, tmp_path, sessions, pages, links, budget)) >= 2


def test_reasons(spark, tmp_path):
    chain = [(url(k), k % 50 // 40, False, 0) for k in range(200)]
    links = [(url(k), 0, url(k + 1), "chapter") for k in range(199)]
    sessions = [(1, "https://x.org", [url(0)]), (2, "https://x.org", [url(198)]), (3, "https://x.org", [url(k) for k in range(48, 50)]), (4, "https://x.org", [url(49), url(48), url(60)])]
    seen = set()
    for n, b in enumerate([Budget(pages=2, depth=9), Budget(saturation=2), Budget(records=2, depth=1), Budget(saturation=0, empty=2), Budget(score=5.5)]):
        seen |= both(spark, tmp_path / str(n), sessions, chain, links, b)
    assert seen == {"page_budget_exhausted", "frontier_empty", "saturation_reached", "high_yield_saturated", "empty_streak_exhausted", "min_score_floor"}


def test_empty_tables(spark, tmp_path):
    empty = [spark.createDataFrame([], s) for s in (SESSION, PAGE, LINK)]
    visits, stops = R.crawl(*empty, folder=str(tmp_path / "a"))
    assert visits.count() == stops.count() == 0
    _, stops = R.crawl(spark.createDataFrame([(1, "https://x.org", ["https://x.org/p1"])], SESSION), *empty[1:], folder=str(tmp_path / "b"))
    assert stops.first()["stop_reason"] == "frontier_empty"


def test_plans_do_not_grow(spark, tmp_path):
    pages, links = [(url(k), 1, False, 0) for k in range(30)], [(url(k), 0, url(k + 1), "chapter") for k in range(29)]
    sizes = []
    for n in (1, 3):
        visits, _ = R.crawl(spark.createDataFrame([(1, "https://x.org", [url(0)])], SESSION), spark.createDataFrame(pages, PAGE), spark.createDataFrame(links, LINK), Budget(pages=n, depth=99), str(tmp_path / str(n)))
        assert visits.count() == n
        sizes.append(len(visits._jdf.queryExecution().analyzed().toString().splitlines()))
    assert sizes[0] == sizes[1]
