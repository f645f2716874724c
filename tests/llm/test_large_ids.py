import base64
import hashlib

from cuewright.llm import warc


def test_page_ids_beyond_doubles(spark, tmp_path):
    big = 1 << 60
    pages = [(big + 1, "a"), (big + 3, "a"), (big + 5, "b"), (None, "c"), (None, "a"), ((1 << 63) - 1, "c"), ((1 << 63) - 2, None), (-(1 << 63), "d"), (5, "e"), (5, "e")]
    rows = [(i, f"https://example.org/{k}", x) for k, (i, x) in enumerate(pages)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/sf/pages.parquet")
    found = warc.op7_warc(spark, f"{tmp_path}/sf").collect()
    first = {}
    for i, _, x in rows:
        if i is not None:
            first[x or ""] = min(i, first.get(x or "", i))
    want = []
    for i, _, x in rows:
        data, own = (x or "").encode(), first.get(x or "")
        kind = "response" if i == own else "revisit"
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, own if kind == "revisit" else None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in found))) == sorted(map(repr, want))
