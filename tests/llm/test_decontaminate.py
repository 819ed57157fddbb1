"""Benchmark decontamination against all item x document distances."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docengine.llm import decontaminate as D

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sellers(item, text):
    """Least edit distance between the item and any substring of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def column(texts):
    return pa.array(texts, pa.large_string())


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 9))) for _ in range(n))


def edited(rng, text, rate, kinds):
    out = []
    for c in text:
        kind = rng.choice(kinds) if rng.random() < rate else "keep"
        out.append({"keep": c, "replace": rng.choice(LETTERS), "insert": c + rng.choice(LETTERS), "drop": ""}[kind])
    return "".join(out)


def test_distance_is_exact():
    rng = random.Random(3)
    for _ in range(40):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90))).strip() or "a"
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        items = D.Items([item])
        assert items.distance(0, text) == sellers(items.flat[0], text)


def real_items(_):
    return pq.read_table("/root/testdata/sf0.1/benchmark.parquet")["text"].to_pylist()


@pytest.mark.parametrize("size", [0, 1, 2, 4, 12, 16, 45, 90])
@pytest.mark.parametrize("kinds", [("replace",), ("replace", "insert", "drop")])
def test_recall_over_rates_and_sizes(size, kinds):
    rng = random.Random(size)
    benchmark = [words(rng, size) for _ in range(40)] if size else real_items(rng)
    items = D.Items(benchmark)
    for rate in (0, 0.02, 0.05, 0.1, 0.15):
        texts, own = [], []
        for k, item in [*enumerate(benchmark)] * (5 if size else 1):
            text = f"{words(rng, rng.randrange(12))} {edited(rng, item, rate, kinds)} {words(rng, 12)}"
            if items.distance(k, D._flat(text)) <= items.k[k]:
                texts.append(text)
                own.append(k)
        got = items.leaks(column(texts))
        found = sum(any(x["item"] == k for x in row) for k, row in zip(own, got, strict=True))
        assert len(own) > 100 and found >= (len(own) if rate == 0 else 0.9 * len(own)), (rate, found, len(own))


@pytest.mark.parametrize("hits", [6_000_000, 3_000])
def test_all_items_against_all_documents(monkeypatch, hits):
    monkeypatch.setattr(D, "HITS", hits)
    monkeypatch.setattr(D, "MANY", 1 if hits == 3_000 else 48)
    rng = random.Random(11)
    for letters, max_edits in [("abcdefgh  ", 0.2), ("abcdefghijklmnopqrstuvwxyzé ", 0.2), ("abcdefghijkl ", 0.05), ("abcd ", 0.0)]:
        draw = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        benchmark = [draw(n) for n in [*range(1, 40), 63, 64, 65, 90, 128, 150, 200] for _ in range(2)]
        items, texts = D.Items(benchmark, max_edits), []
        for item in benchmark:
            w = list(item)
            for _ in range(rng.randrange(int(max_edits * len(item)) + 2)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", *letters])
            texts += [draw(30) * rng.randrange(2) + "".join(w) + draw(25) * rng.randrange(2), draw(rng.randrange(60))]
        got = [{x["item"]: x["distance"] for x in row} for row in items.leaks(column(texts))]
        near = found = least = 0
        for text, row in zip(texts, got, strict=True):
            want = {k: items.distance(k, D._flat(text)) for k, t in enumerate(items.flat) if t}
            want = {k: n for k, n in want.items() if n <= items.k[k]}
            assert row.keys() <= want.keys() and all(want[k] <= n <= items.k[k] for k, n in row.items())
            assert all(k in row for k, n in want.items() if n == 0)
            near, found, least = near + len(want), found + len(row), least + sum(want[k] == n for k, n in row.items())
        assert found >= 0.9 * near and least >= 0.98 * found, (letters, max_edits, near, found, least)


def test_documents_that_begin_or_end_inside_an_item():
    rng = random.Random(8)
    benchmark = [words(rng, 40) for _ in range(30)]
    items, near, found = D.Items(benchmark), 0, 0
    for k, text in enumerate(benchmark):
        for cut in (2, 4, 6, 7):
            for rest in (" ".join([*text.split()[cut:], words(rng, 30)]), " ".join([words(rng, 30), *text.split()[:-cut]])):
                if items.distance(k, rest) > items.k[k]:
                    continue
                near += 1
                got = [[x["item"] for x in r] for r in items.leaks(column(["other words stand here", rest, "", rest]))]
                assert not got[0] and not got[2] and got[1] == got[3]
                found += got[1] == [k]
    assert near > 150 and found == near


def test_rows_do_not_depend_on_each_other(monkeypatch):
    rng = random.Random(9)
    benchmark = [words(rng, rng.choice([1, 2, 5, 20, 40])) for _ in range(40)]
    texts = [f"{words(rng, rng.randrange(9))} {edited(rng, rng.choice(benchmark), 0.12, ['replace', 'drop'])}"[: rng.randrange(400)] for _ in range(120)]
    items = D.Items(benchmark)
    alone = [items.leaks(column([t]))[0] for t in texts]
    for _ in range(3):
        order = rng.sample(range(len(texts)), len(texts))
        monkeypatch.setattr(D, "WALK_BYTES", rng.choice([100, 1000, 400_000]))
        assert items.leaks(column([texts[k] for k in order])) == [alone[k] for k in order]


def test_copies_in_other_cases_and_blanks():
    benchmark = ["Сегодня мы читаем старую книгу о дальних морях и кораблях", "élan über été öffnen çà où naïve garçon être", "ο λόγος του ανθρώπου και της πόλεως είναι μεγάλος", "one two three four five six seven eight"]
    items = D.Items(benchmark)
    for k, text in enumerate(benchmark):
        for copy in (text, text.upper(), text.title(), text.replace(" ", "\u00a0"), text.replace(" ", "\u2003\u2028"), text.replace(" ", "\x1f")):
            got = items.leaks(column(["before it", f"x y\u00a0z {copy} after"]))
            assert not got[0] and [(x["item"], x["distance"]) for x in got[1]] == [(k, 0)], (k, copy)


def test_the_word_found_and_clean_texts():
    benchmark = real_items(0)
    items, rng = D.Items(benchmark), random.Random(2)
    got = items.leaks(column([f"some words before {t} and after" for t in benchmark]))
    assert all((k, 3, 0) in [(x["item"], x["start_word"], x["distance"]) for x in row] for k, row in enumerate(got))
    assert not any(items.leaks(column([words(rng, 300) for _ in range(100)])))
    assert [(x["item"], x["start_word"]) for x in D.Items(["Zq"]).leaks(column(["", "a b zq c"]))[1]] == [(0, 2)]


def test_very_long_and_repetitive_texts():
    rng = random.Random(6)
    item = words(rng, 40)
    items = D.Items([item, "la " * 60])
    long = " ".join([words(rng, 60_000), edited(rng, item, 0.05, ["replace"]), words(rng, 60_000), "la " * 30_000])
    assert [x["item"] for x in items.leaks(column([long]))[0]] == [0, 1]


def test_odd_inputs(spark):
    rows = [(1, "x Alpha  beta gamma delta\nepsilon zeta y", 1), (1, "x Alpha  beta gamma delta\nepsilon zeta y", 1), (None, None, 2), (3, "", 3), (4, "nothing here at all", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta", 1), (8, None, 1), (9, " ", 1), (7, "alpha beta gamma delta epsilon zeta", 1)], "item_id long, text string, doc_id int")
    got = D.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in got} == {(1, 7, 0, 1)} and len(got) == 4
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["leaks"] for r in kept.collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        D.Items(["a"], 1.0)


def test_find_leaks_on_the_small_table(spark):
    """The query's rows hold every pair that lies within the edits, by distances of all items to all documents."""
    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    benchmark = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    items, want = D.Items([b["text"] for b in benchmark]), {}
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        flat = D._flat(d["text"] or "")
        for k, b in enumerate(benchmark):
            if (n := items.distance(k, flat)) <= items.k[k]:
                want[d["doc_id"], b["item_id"]] = n
    assert want and got == want
