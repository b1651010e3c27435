"""Pages are parsed few at a time, so that what a Python worker holds does not grow with its input."""

import pyarrow as pa

from quillmesh.sources import blocks as B
from quillmesh.sources import html as H


def test_slices_bound_pages_and_bytes():
    small = pa.RecordBatch.from_pydict({"id": list(range(1000)), "html": [None if k % 7 == 0 else "<p>x" for k in range(1000)]})
    made = list(H.slices(small, 1))
    assert [len(s) for s in made] == [256, 256, 256, 232] and [i for s in made for i in s.column(0).to_pylist()] == list(range(1000))
    mixed = pa.RecordBatch.from_pydict({"html": ["x" * n for n in (10, H.BYTES + 1, H.BYTES - 10, 10, 1)]})
    assert [len(s) for s in H.slices(mixed, 0)] == [1, 1, 2, 1]
    assert list(H.slices(mixed.slice(0, 0), 0)) == []


def test_parsers_take_slices_and_keep_every_page(spark):
    pages = spark.range(2000).selectExpr("id as page_id", "'https://x.org/' as url", "case when id % 10 > 0 then repeat('<p>word</p>', 200) end as html").coalesce(1)
    assert "MapInArrow" in H.parsed(pages)._jdf.queryExecution().optimizedPlan().toString()
    for made, n in ((H.parsed(pages), "n_elements"), (B.trees(pages), "size(nodes)")):
        assert [tuple(r) for r in made.groupBy("text").agg({"page_id": "count"}).selectExpr("length(text)", "`count(page_id)`").sort("length(text)").collect()] == [(0, 200), (999, 1800)]
        assert made.where(f"{n} = 200").count() == 1800


def test_rounds_parse_a_page_once(spark):
    pages = spark.createDataFrame([(k, f"https://x.org/p{k}", f'<a href="/p{2 * k}">A</a><a href="/p{2 * k + 1}">B</a>') for k in range(1, 40)], "page_id int, url string, html string")
    seen = spark.sparkContext.accumulator(0)
    counted = H.parsed(pages).mapInArrow(lambda batches: (seen.add(len(b)) or b for b in batches), H.parsed(pages).schema)
    found = H.crawl_rounds(pages.where("page_id = 1").selectExpr("'s' as session_id", "url"), counted, 3, 5).collect()
    assert sorted((r["depth"], int(r["link"].split("p")[-1])) for r in found) == [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (2, 7), (3, 10), (3, 11), (3, 12), (3, 13), (3, 14)]
    assert seen.value == 39
