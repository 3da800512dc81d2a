"""run() against plain-Python stages, on planted toxic, shared-line and near-copy documents."""

import hashlib
import random
import re
from fractions import Fraction

from test_tokens import check_packing

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(x):
    return x.translate({k: k + 32 for k in range(65, 91)})


def fixture():
    """Rows of documents, labels, and the ids of the planted toxic documents."""
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghilmnorstu", k=r.randrange(2, 9))) for _ in range(300)]
    rows, toxic = [], set()
    for i in range(240):
        w = r.choices(vocabulary, k=r.randrange(30, 120))
        if i % 4 == 0:
            toxic.add(i)
            for k in range(3, len(w), 5):
                w[k] = r.choice(["vilegrunk", "scumwort", "idiotrag"])
        lines = [" ".join(w[:15]), " ".join(w[15:])]
        if i % 10 == 1:
            lines.insert(1, " Click HERE to subscribe " if i % 20 == 1 else "click here to subscribe")
        if i % 80 in (2, 3):
            lines.append("a line of few documents")
        rows.append([i, "\n".join(lines), "en", ("s2", "s1", "s3")[i % 3], 0])
    for i in range(1, 60, 4):  # near copies, exact copies, and too far ones
        w = rows[i][1].split(" ")
        w[-1 :] = ["changed"]
        rows.append([300 + i, " ".join(w), "en", "s1", 0])
    rows += [[400 + i, rows[i][1], "en", "s3", 0] for i in (2, 5, 9)]
    rows += [[450 + i, " ".join(x if k % 4 else "other" for k, x in enumerate(rows[i][1].split(" "))), "en", "s3", 0] for i in (6, 7)]
    for row in rows:
        row[4] = len(row[1])
    return [tuple(x) for x in rows], [(i, int(i in toxic)) for i in range(240)], toxic


def plain_lines(rows):
    seen = {}
    for i, x, *_ in rows:
        for line in x.split("\n"):
            seen.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    frequent = {k for k, v in seen.items() if k and len(v) >= 10}
    return [(i, "\n".join(y for y in x.split("\n") if lower(y.strip(" \t\n\x0b\x0c\r")) not in frequent), *rest) for i, x, *rest in rows], frequent


def plain_near(rows):
    sets = {}
    for i, x, *_ in rows:
        w = WORD.findall(lower(x))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    group = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    return [r for r in rows if group[r[0]] == r[0]]


def plain_mix(rows):
    size = {i: len(WORD.findall(x)) for i, x, *_ in rows}
    own = {}
    for row in rows:
        own.setdefault(row[3], []).append(row)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own))}
    words = {s: sum(size[r[0]] for r in v) for s, v in own.items()}
    total, target, free = Fraction(3 * sum(words.values()), 2), {}, set(own)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * words[s]}
        target |= {s: Fraction(2 * words[s]) for s in full}
        free -= full
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
    out = []
    for s, v in own.items():
        whole = target[s] // words[s]
        more, start = target[s] - whole * words[s], 0
        for row in sorted(v, key=lambda r: int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16)):
            n = size[row[0]]
            out += [row] * (int(whole) + (2 * start + n < 2 * more))
            start += n
    return out


def test_run(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels, toxic = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [r for r in rows if r[0] not in toxic]
    lined, frequent = plain_lines(clean)
    one = plain_near(lined)
    mixed = plain_mix(one)
    assert frequent == {"click here to subscribe"} and len(clean) == len(rows) - 60 and 15 <= len(lined) - len(one) <= 18
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in mixed}
    check_packing([(i, x) for i, x, *_ in mixed], out, lambda x: own.encode(x, add_special_tokens=False).ids)
