"""License scans against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

from pressline.llm import license_scan
from pressline.llm.license_scan import BAND, BASE_PHRASES, INDEXED, LEAST_SHARE, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def standing(words, phrase):
    parts = phrase.split()
    return [k for k in range(len(words)) if words[k : k + len(parts)] == parts]


def by_hand(texts):
    files = [WORD.findall(lowered(t)) for t in texts]
    df = Counter(w for words in files for w in set(words))
    weight = lambda w: max(1, math.floor(1000 * math.log((len(files) + 1) / (df[w] + 1)) + 0.5))
    out = []
    for words in files:
        places = {p: standing(words, p) for p in BASE_PHRASES}
        every = [k for p in places.values() for k in p]
        base = {BASE_PHRASES[p] for p, found in places.items() if found}
        labels, score = set(base), 1.0 if every else 0.0
        for template in TEMPLATES:
            own = license_scan.template_words(template.text)
            distinct = sorted(set(own), key=lambda w: (df[w], w))
            index = distinct[: min(INDEXED, (len(distinct) + 1) // 2)]
            bins = defaultdict(set)
            items = [(w, [k for k, x in enumerate(own) if x == w], [k for k, x in enumerate(words) if x == w]) for w in index]
            items += [(p, standing(own, p)[:1], standing(words, p)) for p in template.phrases]
            for item, there, here in items:
                for a in there:
                    for b in here:
                        for step in (0, 1):
                            bins[(b - a) // BAND - step].add(item)
            total = sum(map(weight, index))
            for found in bins.values():
                share = sum(weight(w) for w in found if " " not in w) / total
                if share >= LEAST_SHARE and set(template.phrases) <= found:
                    labels.add(template.label)
                    score = max(score, share)
        out.append((len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


def corpus():
    rng = random.Random(5)
    plain = "the of and a file work this under is to be in software rights notice x y z été ΣΑΣ".split()
    texts = [None, "", "  ", "MIT", "mit License MIT LICENSE", "cc-by cc\nby ccby", "this wor\u212a is licensed under cc by", "\u212aMIT license", "gnu general public license" * 2, "ＭＩＴ license", "mİt license"]
    for template in TEMPLATES:
        noise = " ".join(rng.choice(plain) for _ in range(200))
        words = template.text.split()
        texts += [
            template.text, f"{noise} {template.text}\n{noise}", "\n * ".join(words), template.text.upper(),
            " ".join(words[: len(words) // 2]), " ".join(rng.sample(words, len(words))), " ".join(w for w in words if rng.random() > 0.2),
            " ".join(words[:3] + ["inserted"] * 5 + words[3:]), " ".join(words[:3] + ["far"] * 40 + words[3:]),
        ]
    texts += [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    texts.append("license " * 3000 + TEMPLATES[1].text + " license" * 3000)
    texts.append("ab" * 200000)
    return texts + texts[20:40]


def test_equals_plain_python(spark):
    texts = corpus()
    rows = [(None if k % 50 == 7 else k, t, "w", 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, row int").repartition(6)
    got = sorted((tuple(r) for r in license_scan.scan_licenses(docs).collect()), key=repr)
    want = sorted(((r[0], *w) for r, w in zip(rows, by_hand(texts))), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-12, (a, b)


def test_notices_are_found_and_ordinary_text_is_not(spark):
    docs = spark.createDataFrame(
        [(k, t.text) for k, t in enumerate(TEMPLATES)] + [(100, "The license plate of the car is on file; permission to use the software was granted, without warranties.")],
        "doc_id long, text string",
    )
    found = {r.doc_id: r.labels.split(",") for r in license_scan.scan_licenses(docs).collect()}
    for k, template in enumerate(TEMPLATES):
        assert template.label in found[k]
    assert found[100] == [""]


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    scanned = license_scan.scan_licenses(empty)
    assert scanned.count() == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
