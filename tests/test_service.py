"""The book service as a data source against a local server, and model waves against clients that fail."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from rivulet.operators import waves
from rivulet.sources import service

LONG = "a text that is long enough "


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        books = [{"bookId": f"b{i}", "BookName": f"Book {i}", "volume": i % 2 + 1, "translator": "T"} for i in range(4)]
        asked, busy = Counter(), Counter({"b1": 2, "allbooks": 1})

        def do_GET(self):  # noqa: N802
            name = self.path.rsplit("/", 1)[1]
            self.asked[name] += 1
            if self.busy[name] > 0:
                self.busy[name] -= 1
                self.send_response(429)
                self.send_header("Retry-After", "0.05")
                self.end_headers()
                return
            body = self.books if name == "allbooks" else [{"id": j, "arabicText": LONG + name, "englishText": (LONG if j < 3 else "short") + str(j), "chapter": None} for j in range(4)]
            if name == "b3":
                self.send_response(500)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/api", Handler
    http.shutdown()


def test_books_and_pushed_filters(spark, server):
    url, handler = server
    service.register(spark)
    books = spark.read.format("book_service").option("url", url).option("wait", "0.01").load()
    rows = books.collect()
    assert Counter(r.book_id for r in rows if r.error is None) == {"b0": 3, "b1": 3, "b2": 3}
    assert [(r.book_id, r.ar, "500" in r.error) for r in rows if r.error] == [("b3", None, True)]
    assert handler.asked["b1"] == 3 and handler.asked["b3"] == 3
    handler.asked.clear()
    one = books.where("book_id = 'b2' and hadith_id = '1'").collect()
    assert [(r.book, r.hadith_id, r.volume) for r in one] == [("Book 2", "1", 1)] and set(handler.asked) == {"allbooks", "b2"}
    handler.asked.clear()
    assert books.where(F.col("volume") == 2).where(F.col("book_id").isin("b1", "b2")).count() == 3 and set(handler.asked) == {"allbooks", "b1"}


def test_a_stream_goes_on_behind_the_last_book(spark, server, tmp_path):
    url, handler = server
    service.register(spark)
    handler.books = handler.books[:2]

    def once():
        stream = spark.readStream.format("book_service").option("url", url).option("wait", "0.01").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return Counter(r.book_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert once() == {"b0": 3, "b1": 3}
    handler.asked.clear()
    handler.books = [*handler.books, {"bookId": "b9"}]
    assert once() == {"b0": 3, "b1": 3, "b9": 3} and "b0" not in handler.asked and handler.asked["b9"] == 1


class Flaky:
    """Answers with the prompt's entries; the first calls of each batch are refused or wrong. Calls are counted in files, for tasks are other processes."""

    def __init__(self, folder, bad=2):
        self.folder, self.bad = str(folder), bad

    def __call__(self, prompt):
        import os
        import uuid
        from pathlib import Path

        ids = [int(line.split(":")[0][2:]) for line in prompt.splitlines() if line.startswith("# ")]
        part = "lists" if "Give only" in prompt else "all"
        place = Path(self.folder) / f"{ids[0]}-{part}"
        os.makedirs(place, exist_ok=True)
        n = len(list(place.iterdir()))
        (place / uuid.uuid4().hex).touch()
        if ids[0] == 40:
            raise RuntimeError("never")
        if n < self.bad:
            if n == 0:
                raise waves.Later(0.01)
            return json.dumps([{}] * (len(ids) - 1))
        if part == "lists":
            return json.dumps({"teachers": ["x", "y"]})
        out = [{"name": f"n{i}", "teachers": None if "Leave out" in prompt else ["z"]} for i in ids]
        return json.dumps([*out, {"name": "fused"}] if ids[0] == 16 else out)


def test_waves_resume_and_ask_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (500 if i == 11 else 5)) for i in range(60)] + [(None, "x")], "idx long, text string").repartition(5)
    calls = tmp_path / "calls"
    calls.mkdir()
    ask = lambda **more: waves.run(df, "idx", "text", ["name"], Flaky(calls), str(tmp_path / "out"), lists=["teachers"], giant=100, wait=0.001, **more)
    got = {(r.idx, r.position): (r["name"], r.teachers, r.error) for r in ask(wave=3).collect()}
    good = {k: v for k, v in got.items() if v[2] is None}
    assert {i for i, _ in got} == set(range(60)) and {i for i, _ in got if (i, 0) not in good} == set(range(40, 48))
    assert good[11, 0] == ("n11", '["x", "y"]', None) and good[5, 0] == ("n5", '["z"]', None) and good[23, 1][0] == "fused"
    made = {p.name: len(list(p.iterdir())) for p in calls.iterdir()}
    assert made["0-all"] == 3 and made["11-all"] == 3 and made["11-lists"] == 3 and made["40-all"] == 3
    assert len(list((tmp_path / "out").glob("part=*"))) == 3  # eight batches and the giant entry in waves of three
    ask()  # all is stored
    assert {p.name: len(list(p.iterdir())) for p in calls.iterdir()} == made
    again = {(r.idx, r.position): r.error for r in ask(again=True).collect()}
    now = {p.name: len(list(p.iterdir())) for p in calls.iterdir()}
    assert set(again) == set(got) and now["40-all"] == 6 and {k: v for k, v in now.items() if k != "40-all"} == {k: v for k, v in made.items() if k != "40-all"}


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(32)], "idx long, text string")
    calls = tmp_path / "calls"
    calls.mkdir()
    first = waves.run(df.where("idx < 16"), "idx", "text", ["name"], Flaky(calls, 0), str(tmp_path / "out"), wave=1)
    assert first.count() == 16
    every = waves.run(df, "idx", "text", ["name"], Flaky(calls, 0), str(tmp_path / "out"), wave=10)
    assert every.where("position = 0").count() == 32
    assert {p.name: len(list(p.iterdir())) for p in calls.iterdir()} == {"0-all": 1, "8-all": 1, "16-all": 1, "24-all": 1}
