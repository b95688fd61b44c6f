"""The whole pipeline against a plain Python version of it."""

import zlib
from collections import Counter, defaultdict

import brute

import corpus_pipeline
from riskspark.llm import queries

SF = "/root/testdata/sf0.001"
TOP = 600


def grams(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        for n, s in ((1, word), (2, padded), (3, padded)):
            found.update(s[i : i + n] for i in range(len(s) - n + 1))
    return found


def ranking(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:TOP]


def languages(docs):
    by, of = defaultdict(Counter), {}
    for d in docs:
        of[d.doc_id] = grams(d.text)
        if d.lang is not None:
            by[d.lang].update(of[d.doc_id])
    profiles = {lang: {g: i for i, g in enumerate(ranking(c))} for lang, c in sorted(by.items())}
    kept = {}
    for d in docs:
        own = ranking(of[d.doc_id])
        score = {lang: 1 - sum(min(TOP, abs(p[g] - i)) if g in p else TOP for i, g in enumerate(own)) / len(own) / TOP for lang, p in profiles.items()} if own else {}
        if score and max(score.values()) >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept[d.doc_id] = d.lang or max(score, key=score.get)
    return kept


def first_of_groups(docs, words=5, percent=80):
    sets, root = [(d, brute.shingles(t, words)) for d, t in docs], {d: d for d, _ in docs}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and root[a] != root[b] and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root[a], root[b]))
                root = {d: p if r == q else r for d, r in root.items()}
    return {d for d, _ in sets if root[d] == d}


def targets(sizes, weights, total):
    found, free = {}, set(sizes)
    while free:
        share = {s: total * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return found | share
        found |= {s: 2 * sizes[s] for s in over}
        total -= sum(2 * sizes[s] for s in over)
        free -= over
    return found


def test_op2_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    taught = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 != 1]
    by, profiles = defaultdict(Counter), {}
    for d in taught:
        if d.lang is not None:
            by[d.lang].update(grams(d.text))
    profiles = {lang: {g: i for i, g in enumerate(ranking(c))} for lang, c in sorted(by.items())}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    for d in docs:
        own = ranking(grams(d.text))
        score = {lang: 1 - sum(min(TOP, abs(p[g] - i)) if g in p else TOP for i, g in enumerate(own)) / len(own) / TOP for lang, p in profiles.items()} if own else {"und": 0.0}
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == max(score, key=score.get) and abs(r.score - max(score.values())) < 1e-9


def test_stages_take_odd_rows_and_clashing_names(spark):
    text = [" ".join(f"word{chr(97 + i)}{j}x" for j in range(40)).replace("0", "o") for i in range(6)]
    rows = [(1, text[0], "en", "s"), (1, text[0], "en", "s"), (None, text[1], None, None), (None, text[1], "en", "t"), (4, None, None, "s"), (5, text[2] + " more", "en", "s"), (6, text[2], "en", "s"), (7, text[3], "en", "s"), (7, text[4], "en", "t"), (8, "", "en", "s")]
    names = ["_th", "th", "kd", "kt", "copies", "copy", "doc", "id", "size", "sources", "lang_pred", "score", "n", "word"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and stage(spark, df.where("false"), SF).count() == 0
        left[name] = Counter((r.doc_id, r.text) for r in out.collect())
    assert left["language_id"] == Counter(r[:2] for r in rows if r[1])
    assert left["near_dedup"] == Counter([(1, text[0]), (None, text[1]), (4, None), (5, text[2] + " more"), (7, text[3]), (7, text[4]), (8, "")])
    assert left["decontamination"] == Counter(r[:2] for r in rows)
    assert corpus_pipeline.shard(spark, df, SF).count() == len(rows)


def test_run_equals_brute_force(spark, tmp_path):
    given, test = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    long = max((r.text for r in given.collect()), key=len)
    own = [(9001, None, "en"), (9002, "12 34 -- 56", "en"), (9003, "", None), (9004, "\u6f22\u5b57\u4eee\u540d " * 9, None), (9005, long.replace(" ", "  "), None)]
    added = spark.createDataFrame([(*r, "src1", 7) for r in own], "doc_id long, text string, lang string, source string, n_chars long")
    given.unionByName(added.select(*[added[c].cast(t) for c, t in given.dtypes])).write.parquet(f"{tmp_path}/documents.parquet")
    test.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, items = spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), [(r.item_id, r.text) for r in test.collect()]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lang = languages(docs)
    left = [d for d in docs if d.doc_id in lang]
    firsts = first_of_groups([(d.doc_id, d.text) for d in left])
    left = [d for d in left if d.doc_id in firsts]
    dirty = {r[0] for r in brute.op1([(d.doc_id, d.text) for d in left], items) if r[-1]}
    left = {d.doc_id: d for d in left if d.doc_id not in dirty}
    assert len(dirty) > 0 and len(firsts) < len(lang) < len(docs)

    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(left)
    assert all((r.lang, r.source, r.n_chars) == (lang[r.doc_id], left[r.doc_id].source, left[r.doc_id].n_chars) for r in got)
    words = {d: len(brute.TOKEN.findall(x.text)) for d, x in left.items()}
    by = defaultdict(list)
    for d, x in left.items():
        by[x.source].append(d)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets({s: sum(words[d] for d in by[s]) for s in names}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(words.values()))
    for s in names:
        times = {copies[d] for d in by[s]}
        assert max(times) <= 2 and max(times) - min(times) <= 1
        assert abs(sum(copies[d] * words[d] for d in by[s]) - want[s]) <= max(words[d] for d in by[s])

    order = sorted((d, zlib.crc32(left[d].text.encode()), len(left[d].text.encode()) + 16) for d in copies.elements())
    total, before, places, slots = sum(x[2] for x in order), 0, [], Counter()
    for d, crc, size in order:
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        places.append((d, crc, size, shard, slots[shard]))
        slots[shard] += 1
        before += size
    assert sorted((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in got) == places
