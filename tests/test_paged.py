"""The paged source: every page once, also over a failure and a restart; the rate shared; what a reply holds."""

import json
import os

from linkloom.sources import paged

WEB = {f"T{k}": 1 + k % 4 for k in range(11)}  # pages of each title


def fetcher(log, fail=None):
    def fetch(params):
        import os

        title, token = params["titles"], params.get("plcontinue", "0")
        if fail and title == "T5" and os.path.exists(fail):
            os.remove(fail)
            os._exit(1)  # the worker dies in the middle of its round
        with open(log, "a") as f:
            f.write(json.dumps([title, token]) + "\n")
        if title == "T7":
            raise OSError("no answer")
        if title == "T8":
            return {"query": {"pages": {"-1": {"title": title, "missing": ""}}}}
        k = int(token)
        page = {"links": [{"title": f"{title}.{k}"}, {"title": "Category:no"}]}
        if k == 0:
            page |= {"extract": f"About {title}.", "categories": [{"title": "Category:A"}], "pageviews": {"d1": 3, "d2": None, "d3": 4}}
        return {"query": {"pages": {"9": page}}} | ({"continue": {"plcontinue": str(k + 1)}} if k + 1 < WEB[title] else {})

    return fetch


def test_no_page_is_asked_for_twice(spark, tmp_path):
    log, fail = str(tmp_path / "log"), str(tmp_path / "fail")
    open(fail, "w").close()
    titles = sorted(WEB)
    for run in range(2):
        paged.register(spark, fetcher(log, fail if run == 0 else None), titles, str(tmp_path / "progress"), f"pages{run}", shards=3, pages=2, per_second=1000)
        q = spark.readStream.format(f"pages{run}").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        except Exception:
            assert run == 0
        q.stop()
    asked = [tuple(json.loads(x)) for x in open(log)]
    want = [(t, str(k)) for t, n in WEB.items() for k in range(1 if t in ("T7", "T8") else n)]
    assert sorted(set(asked)) == sorted(want)
    # only the round that died with its worker may be asked again, before it was kept
    assert len(asked) - len(set(asked)) <= 2 and not os.path.exists(fail)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.title, str(r.page)) for r in rows.collect()) == sorted(want)
    got = {r.title: r for r in paged.articles_of(rows).collect()}
    assert sorted(got) == sorted(t for t in WEB if t not in ("T7", "T8"))
    assert got["T3"].links == ["T3.0", "T3.1", "T3.2", "T3.3"] and got["T3"].snippet == "About T3." and got["T3"].views == 7 and got["T3"].categories == ["Category:A"]
    assert [(r.error, r.missing) for r in rows.where("title in ('T7', 'T8')").orderBy("title").collect()] == [("no answer", False), (None, True)]


def test_budget_is_shared_and_rounds_are_kept(tmp_path):
    waits = []
    r = paged.PagedReader(fetcher(str(tmp_path / "log")), sorted(WEB), str(tmp_path / "p"), 4, 3, 8.0, waits.append)
    end = r.latestOffset()
    assert end == {"round": 1} and r.initialOffset() == {"round": 0}
    first = [row for part in r.partitions({"round": 0}, end) for row in r.read(part)]
    n = len(waits)
    again = [row for part in r.partitions({"round": 0}, end) for row in r.read(part)]
    assert [list(map(str, x)) for x in first] == [list(map(str, x)) for x in again] and len(waits) == n  # nothing is asked again
    assert set(waits) == {0.5}  # 4 shards at 8 a second in all
    rounds = 1
    while (end := r.latestOffset())["round"] > rounds:
        list(row for part in r.partitions({"round": rounds}, end) for row in r.read(part))
        r.commit(end)
        rounds = end["round"]
    assert sum(1 for _ in open(tmp_path / "log")) == sum(1 if t in ("T7", "T8") else k for t, k in WEB.items())
