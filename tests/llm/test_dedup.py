"""Dedup operators against brute force, on rows with nulls, repeats, ties, clashing columns and a long text."""

import hashlib
import random
import re

import pytest

from tarmaq.llm import line_dedup, near_dedup, registry, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(seed=3):
    r = random.Random(seed)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "té", "Zu") for b in ("ra", "x", "ön", "p")]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, base = say(40), say(90).split()
    out = [say(r.randrange(1, 120)) for _ in range(30)]
    out += [say(10) + " " + passage + "\n" + say(12) for _ in range(8)] + [passage, passage + " " + passage]
    for k in (1, 2, 2, 5, 9, 30):
        edited = list(base)
        for i in r.sample(range(90), k):
            edited[i] = f"e{r.random():.6f}"
        out.append(" ".join(edited))
    out += [" ".join(base)] * 5 + [" ".join(base).upper()]
    out += [None, "", " \n\t ", "a", "a b", "A b", "one two three four", " lines \nLINES\n\nx", "same\r\nsame"] + [f"Shared Line  \n{say(3)}" for _ in range(12)]
    out.append(" ".join([say(50)] * 4 + [f"u{i}" for i in range(30000)]))
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    ids = list(range(5, 5 + len(t)))
    random.Random(1).shuffle(ids)
    out = [(i, x, "id", "DOC") for i, x in zip(ids, t, strict=True)]
    return [*out, out[3], out[40], (None, out[33][1], None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that the operators use as names of their own.
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key string").repartition(3).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substrings(docs, rows):
    n = 20
    first = {}
    for i, x, *_ in rows:
        w = WORD.findall(x or "")
        for k in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    want = []
    for i, x, *_ in rows:
        w = WORD.findall(x or "")
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < (i, k) for j in range(n)}
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[2] for r in want) > 100


def test_branching_paths_in_one_chunk(spark, monkeypatch):
    # One passage in very many contexts: a minimiser with more paths than a chunk sends.
    monkeypatch.setattr(substring_dedup, "LOCAL_PATHS", 2)
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(i, f"{' '.join(f'a{i}x{k}' for k in range(22))} {passage} {' '.join(f'b{i}x{k}' for k in range(22))}") for i in range(30)], "doc_id long, text string").coalesce(2)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {0: 0} | {i: 25 for i in range(1, 30)}


def test_near(docs, rows):
    sets = {}
    for i, x, *_ in rows:
        w = WORD.findall(x.translate({k: k + 32 for k in range(65, 91)})) if x else []
        sets[i, x] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    by_id = {i: s for (i, _), s in sets.items() if i is not None}
    group = {i: i for i in by_id}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in by_id:
        for b in by_id:
            if a < b and by_id[a] and 100 * len(by_id[a] & by_id[b]) >= 80 * len(by_id[a] | by_id[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    want = [(i, len(sets[i, x]), None if i is None else root(i), i is None or root(i) == i) for i, x, *_ in rows]
    got = [tuple(r) for r in near_dedup.near_groups(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r[2] for r in want}) < len(rows) - 10


def test_far_copies_of_one_text(spark):
    """Copies of one text edited too far to be linked with it, some of them edited alike: all links without listing all pairs."""
    r = random.Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(160)]
    texts = [list(base)]
    for k in range(120):
        own = list(r.choice(texts[-6:]) if k % 3 == 0 else base)
        for at in r.sample(range(160), r.choice((1, 2, 4, 6, 7, 8, 10, 14))):
            own[at] = f"e{r.randrange(10**9)}" if k % 2 else f"w{r.randrange(400)}"
        texts.append(own)
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    sets = [{tuple(x[k : k + 4]) for k in range(len(x) - 3)} for x in texts]
    group = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) > 15


def test_lines(docs, rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate({k: k + 32 for k in range(65, 91)})
    seen = {}
    for i, x, *_ in rows:
        for line in (x or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    bad = {k for k, v in seen.items() if k and len(v) >= 10}
    want = []
    for i, x, a, b in rows:
        lines = (x or "").split("\n")
        kept = [y for y in lines if key(y) not in bad]
        want.append((i, None if x is None else "\n".join(kept), a, b, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = [tuple(r) for r in line_dedup.drop_frequent_lines(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and bad == {"shared line"}


def test_hot_lines_are_few(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    cold = {tuple(r) for r in line_dedup.drop_frequent_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 10**6)
    assert cold == {tuple(r) for r in line_dedup.drop_frequent_lines(docs).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).isEmpty() and near_dedup.near_groups(none).isEmpty() and line_dedup.drop_frequent_lines(none).isEmpty()


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql()))
def test_oracles(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])
