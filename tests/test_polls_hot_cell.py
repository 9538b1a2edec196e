"""A cell holding most of the polls spans many range partitions; the
carry-in logic must give the serial result."""

import datetime as dt
import random

from quillspark.operators import polls as PO

POLLS = "cell long, ts timestamp, seq long, text string"


def serial_quiescence(rows, gap, timeout, min_len=30, markers=("Thinking", "Generating")):
    out = {}
    by = {}
    for c, t, s, x in rows:
        by.setdefault(c, []).append((t, s, x))
    for c, rs in by.items():
        rs.sort()
        start = rs[0][0]
        rem, run_start, n_run, res = None, None, 0, None
        last = None
        for t, s, x in rs:
            if t - start >= timeout:
                break
            if any(m in x for m in markers):
                rem, run_start, n_run, last = "", None, 0, ("m", x)
                continue
            if len(x) < min_len:
                continue
            if rem and x == rem:
                n_run += 1
                last = ("v", x)
                if t - run_start >= gap:
                    res = ("complete", x, run_start - start)
                    break
            else:
                rem, run_start, n_run, last = x, t, 1, ("v", x)
        if res is None:
            if last is None or last[0] == "m":
                res = ("error", "ERROR: Timeout waiting for response", 0.0)
            else:
                res = ("partial", last[1], (run_start - start) if n_run > 1 else float(timeout))
        out[c] = res
    return out


def serial_stable(rows, n=3, min_len=20):
    by = {}
    for c, t, s, x in rows:
        by.setdefault(c, []).append((t, s, x))
    out = {}
    for c, rs in by.items():
        rs.sort()
        last, cnt, res = None, 0, None
        for t, s, x in rs:
            if x == last and len(x) > min_len:
                cnt += 1
                if cnt >= n:
                    res = ("complete", x, s)
                    break
            else:
                cnt, last = 0, x
        out[c] = res or ("timeout", rs[-1][2], None)
    return out


def make_rows(seed=3):
    rnd = random.Random(seed)
    texts = ["A" * 30, "B" * 30, "C" * 31, "Thinking", "tiny"]
    rows, seq = [], 0
    for c, n in [(1, 3000), (2, 40), (3, 25), (4, 5)]:
        t = 0.0
        for _ in range(n):
            t += rnd.choice([1.0, 2.0, 5.0, 9.0])
            seq += 1
            rows.append((c, t, seq, rnd.choices(texts, weights=[5, 3, 1, 1, 1])[0]))
    return rows


def frame(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, base + dt.timedelta(seconds=t), s, x) for c, t, s, x in rows], POLLS)


def test_hot_cell_quiescence(spark):
    rows = make_rows()
    got = {r.cell: (r.status, r.response, r.latency_s) for r in
           PO.quiescence(frame(spark, rows), gap_s=8, timeout_s=100000).collect()}
    assert got == serial_quiescence(rows, 8, 100000)


def test_hot_cell_stable(spark):
    rows = make_rows(5)
    got = {r.cell: (r.status, r.response, r.done_seq) for r in PO.stable_polls(frame(spark, rows)).collect()}
    assert got == serial_stable(rows)
