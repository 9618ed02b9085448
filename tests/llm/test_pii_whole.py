"""Personal data with evidence from whole documents: against plain Python, on planted terms, and against chance."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm.test_scans import base_pii, copied_texts
from voxelframe.llm import pii

LETTERS = r"(?<![^\W\d_])[^\W\d_]{3,}"


def likelihood(observed, wanted):
    return observed * math.log(observed / max(wanted, 1e-12)) if observed > 0 else 0.0


def expected(texts):
    """Spans of every text, by the definitions and without any pruning."""
    different = list(dict.fromkeys(texts))  # None and "" are two texts
    n = len(different)
    rows, in_texts = {}, defaultdict(set)
    in_rows = Counter(w for text in texts if text is not None for w in {w.lower() for w in re.findall(LETTERS, text)})
    n_term = {t: count * (n / len(texts)) for t, count in in_rows.items()}
    for text in different:
        plain = text or ""
        base = sorted(base_pii(plain), key=lambda s: (s[1], s[0]))
        blank = "".join("#" if any(a <= i < b for _, a, b, _ in base) else c for i, c in enumerate(plain))
        found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(LETTERS, blank)]
        mentions = [(f"{k}:{plain[a:b].lower()}", a, b) for _, a, b, k in base]
        for e, *_ in mentions:
            in_texts[e].add(text)
        rows[text] = (base, blank, found, mentions)
    both, k, k_all, near_in, weight = Counter(), Counter(), Counter(), Counter(), Counter()
    for text, (_, blank, found, mentions) in rows.items():
        here = Counter(t for t, *_ in found)
        for e in {e for e, *_ in mentions}:
            both.update((e, t) for t in here)
            windows = [(max(a - pii.NEAR, 0), a, b, b + pii.NEAR) for x, a, b in mentions if x == e]
            size = sum(a + 1 - low + (1 if low == 0 else 1) - 1 + min(pii.NEAR + 1, len(blank) + 1 - b) for low, a, b, _ in windows)
            w = min(0.5, size / (len(blank) + 2))
            close = Counter(t for low, a, b, high in windows for t, s, f in found if s >= low and f <= a or s >= b and f <= high)
            for t, count in close.items():
                k[e, t] += min(count, here[t])
                k_all[e, t] += here[t]
                weight[e, t] += here[t] * w
                near_in[e, t] += 1
    tests = {}
    for (e, t), together in both.items():
        n_e = len(in_texts[e])
        if n_e == n or t not in n_term:
            continue
        known = together > 1 and in_rows[t] > 1 and n_e > 1 and n_term[t] <= n_e**pii.GENERALISE_FROM * max(n, 2) ** (1 - pii.GENERALISE_FROM) * 1.001
        if not known and (e, t) not in k:
            continue
        x = together if known else near_in[e, t]
        N = float(max(n, 2))
        common = likelihood(x, n_e * n_term[t] / N) + likelihood(n_e - x, n_e * (N - n_term[t]) / N) + likelihood(n_term[t] - x, n_term[t] * (N - n_e) / N)
        common = common + likelihood(N - n_e - n_term[t] + x, (N - n_e) * (N - n_term[t]) / N) if x > n_e * n_term[t] / N else 0.0
        close = 0.0
        if (e, t) in k:
            w = weight[e, t] / k_all[e, t]
            if k[e, t] > k_all[e, t] * w:
                close = likelihood(k[e, t], k_all[e, t] * w) + likelihood(k_all[e, t] - k[e, t], k_all[e, t] * (1 - w))
        tests[e, t] = (round(math.log2(N * x / (n_term[t] * n_e)) / math.log2(N / n_e), 9), common + close)
    judged = {}
    for (_, t), (share, score) in tests.items():
        if share >= pii.GENERALISE_FROM and score >= math.log(len(tests) / pii.CHANCE):
            judged[t] = judged.get(t, False) or share >= pii.REMOVE_FROM
    out = []
    for text in texts:
        base = base_pii(text or "")
        more = [(4 if judged[m[0].lower()] else 5, m.start(), m.end(), "reveals" if judged[m[0].lower()] else "hints") for m in re.finditer(LETTERS, text or "") if m[0].lower() in judged]
        more = [s for s in more if not any(a < s[2] and s[1] < b for _, a, b, _ in base)]
        out.append(",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(base + more)))
    return out


def corpus(seed=3, n=400, entities=12, spread=4):
    """(texts, planted terms): every planted term stands somewhere in each of the texts of its entity and nowhere else."""
    rng = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    texts = [[rng.choice(words[:80]) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(n)]
    planted = set()
    for e in range(entities):
        name = f"zyx{chr(97 + e)}name"
        planted.add(name)
        for d in rng.sample(range(n), spread):
            texts[d].insert(rng.randrange(len(texts[d])), name.title() if rng.random() < 0.5 else name)
            texts[d].insert(rng.randrange(len(texts[d])), f"user{e}@mail.example.com")
    return [" ".join(t) for t in texts], planted


def scanned(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.spans for r in sorted(pii.report(frame, whole=True).collect())]


@pytest.mark.parametrize("texts", [corpus()[0], [*corpus(5, 150, 6, 3)[0], *corpus(5, 150, 6, 3)[0][:40], None, None, "", "one", "one"], copied_texts()], ids=["planted", "copies", "few words"])
def test_against_plain_python(spark, texts):
    assert scanned(spark, texts) == expected(texts)


def marked(texts, spans):
    return [[t[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in line.split(",") if s) if k in ("reveals", "hints")] for t, line in zip(texts, spans)]


def test_planted_terms_are_found_and_others_left_alone(spark):
    texts, planted = corpus(8, 600, 20, 4)
    found = marked(texts, scanned(spark, texts))
    there = sum(w.lower() in planted for t in texts for w in t.split())
    assert sum(w in planted for f in found for w in f) >= 0.9 * there
    assert sum(w not in planted for f in found for w in f) < 0.001 * sum(len(t.split()) for t in texts)


def test_rare_words_of_one_document_are_no_evidence(spark):
    """8,000 words that stand nowhere else, around one address: none is tied to it; a name that keeps to its side is."""
    rare = [f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}z" for i in range(8000)]
    texts = [" ".join(["a@b.co", *rare]), *(f"plain words of text number{chr(97 + i % 26)}" for i in range(200))]
    found = marked(texts, scanned(spark, texts))
    assert sum(map(len, found)) < 0.01 * 8000
    near = " ".join([*rare[:2000], "Zanzibar c@d.co zanzibar", *rare[2000:4000], "zanzibar c@d.co Zanzibar", *rare[4000:]])
    found = marked([near], scanned(spark, [near, *texts[1:]]))[0]
    assert found.count("zanzibar") == 4 and len(found) < 80


def test_edges(spark, edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    got = pii.report(edges.withColumns({n: F.lit("clash") for n in ("entities", "mentions", "blank", "term", "one", "k", "w", "text_key", "class")}), whole=True).collect()
    want = expected([t for _, t in rows])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in got) == sorted((i is None, i or 0, s) for (i, _), s in zip(rows, want))
    assert pii.report(empty, whole=True).count() == 0
    plan = pii.report(edges, whole=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_sanitise_takes_terms_out_of_every_text(spark):
    texts, planted = corpus(8, 400, 10, 4)
    out = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate([*texts, "only Zyxaname again"])), "doc_id long, text string")).collect()]
    left = sum(w in t.lower() for t in out for w in planted)
    assert len(out) == 401 and left <= 0.1 * 40 and not any("@" in t for t in out)


def test_no_text_travels_to_drop_repeated_rows(spark):
    rows = [(1, "call +1 555 010 2030 Mira"), (1, "call +1 555 010 2030 Mira"), (2, "nothing"), (2, None)]
    plan = pii.scan_whole(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "first(text#" not in plan
