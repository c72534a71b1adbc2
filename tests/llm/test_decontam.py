"""Contamination against brute force on small fixtures; the whole tables go against SQL."""

import random
import re
import time

from pyspark.sql import functions as F

from llm_frames import docs  # noqa: F401

from callboard.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    mine, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        for window in ([w[i : i + 13] for i in range(len(w) - 12)] if len(w) >= 13 else [w] if w else []):
            for i in range(len(mine) - len(window) + 1):
                if mine[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(key))
    return len(mine), len(hit), sorted(found)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "The Answer, is 42!"), (3, None), (4, ""), (5, "!!"), (10, LONG), (6, "é ß"), (7, "a"), (8, " ".join(["x"] * 20)), (9, "W3 w4 w5")]
DOCS = [(1, LONG), (2, None), (3, ""), (4, "... !"), (5, "so THE answer--is 42 ok"), (6, "the answer is 421 aé ß"), (7, "é\nß a b"), (8, "x " * 40),
        (9, " ".join(LONG.split()[3:20])), (10, "q " * 9000 + LONG + " q" * 9000), (11, " ".join(LONG.split()[:12])), (5, "so THE answer--is 42 ok"), (None, "w3 w4 w5")]


def judged(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("block", F.lit(1))
    return decontam.occurrences(docs, decontam.publish(bench)), bench


def test_small_cases_equal_brute_force(spark, docs):
    found, bench = judged(spark, docs(DOCS).drop("found"), ITEMS)
    got = sorted((str(r["doc_id"]), r["found"]["n_words"], r["found"]["n_hit"], list(r["found"]["items"])) for r in found.collect())
    assert got == sorted((str(k), *brute(t, ITEMS)) for k, t in DOCS)
    kept = decontam.clean(docs(DOCS), bench)
    assert kept.columns == ["doc_id", "text", "source", "n", "id", "found"]
    wanted = [str(k) for k, t in DOCS for n, hit, _ in [brute(t, ITEMS)] if not (hit > 0 and 20 * hit >= n)]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(wanted)


def test_many_blocks_of_patterns_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontam, "PART", 2000)
    monkeypatch.setattr(decontam, "HELD", 5000)
    found, _ = judged(spark, docs(DOCS), ITEMS)
    got = sorted((str(r["doc_id"]), r["found"]["n_words"], r["found"]["n_hit"], list(r["found"]["items"])) for r in found.collect())
    assert got == sorted((str(k), *brute(t, ITEMS)) for k, t in DOCS)


def test_empty_tables(spark, docs):
    assert judged(spark, docs([]), ITEMS)[0].count() == 0
    found, bench = judged(spark, docs(DOCS), [])
    assert all(r["found"]["n_hit"] == 0 and r["found"]["items"] == [] for r in found.collect())
    assert decontam.clean(docs(DOCS), bench).count() == len(DOCS)


def spread(seconds, run):
    best = min(timed(run) for _ in range(3))
    assert best < seconds, best


def timed(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_windows_that_end_alike_cost_a_look_up_each():
    """8,000 windows with one ending in 200 KB of text that has the ending everywhere."""
    rng = random.Random(3)
    ending = "and so on to the end of the"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    made = [decontam.normalised(" ".join([*(word() for _ in range(6)), ending])) for _ in range(8000)]
    patterns = decontam.Patterns(made, [[str(i)] for i in range(8000)])
    text = decontam.normalised(" ".join(f"{word()} {ending}" for _ in range(6200)) + made[17].decode() + made[5].decode())
    spread(0.5, lambda: patterns.search(text))
    ends, hits = patterns.search(text)
    assert sorted(hits.tolist()) == [5, 17] and len(text) > 200_000
    # Windows of many lengths with one tail of 64 bytes.
    tail = " ".join(["passage"] * 10)
    made = [decontam.normalised(f"{word()}{'x' * (i % 40)} {tail}") for i in range(8000)]
    patterns = decontam.Patterns(made, [["1"]] * 8000)
    text = decontam.normalised(" ".join(f"{word()} {tail}" for _ in range(2500)))
    spread(1.0, lambda: patterns.search(text))
    wanted = {(m.end(), i) for i, w in enumerate(made[:300]) for m in re.finditer(re.escape(w.decode()), text.decode())}
    assert wanted <= set(zip(*(x.tolist() for x in patterns.search(text))))


def test_search_equals_plain_search_on_drawn_texts():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice(["a", "bb", "ccc", "dddd", "é"]) for _ in range(rng.randint(1, 300))]
        made = list({decontam.normalised(" ".join(words[i : i + rng.randint(1, 30)])) for i in (rng.randrange(len(words)) for _ in range(30))})
        patterns = decontam.Patterns(made, [[str(i)] for i in range(len(made))])
        text = decontam.normalised(" ".join(words))
        found = sorted(zip(*(x.tolist() for x in patterns.search(text))))
        assert found == sorted((e, i) for i, w in enumerate(made) for e in range(len(w), len(text) + 1) if text[e - len(w) : e] == w)
