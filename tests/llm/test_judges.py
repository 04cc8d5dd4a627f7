"""Toxicity, URL filters and license scans."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np

from slotwise.llm import license_scan as L
from slotwise.llm import toxicity as X
from slotwise.llm import url_filter as U
from slotwise.llm.common import table

SAMPLE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SAMPLE, "documents"), table(spark, SAMPLE, "labels")
    model = X.fit(docs, labels)
    scored = X.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), X.F.col("id") == X.F.col("doc_id"))
    held = [(r.score, r.toxic) for r in scored.filter(X.held_out(X.F.col("id"))).collect()]
    caught = [s >= 0.7 for s, y in held if y == 1]
    wrong = [s >= 0.7 for s, y in held if y == 0]
    assert np.mean(caught) >= 0.7
    assert np.mean(wrong) <= 0.02


def test_unseen_misspellings_share_subwords():
    r = random.Random(1)
    words = ["river", "stone", "green", "table", "cloud", "paper", "music", "north"]
    clean = [" ".join(r.choice(words) for _ in range(40)) for _ in range(200)]
    toxic = [" ".join([*(r.choice(words) for _ in range(20)), r.choice(["blockhead", "numbskull"]), *(r.choice(words) for _ in range(20))]) for _ in range(200)]
    model = X.train(clean + toxic, [0] * 200 + [1] * 200)
    assert model.score("you are a blockheaad indeed") > 0.7 > model.score("green river and cloud") >= 0


def test_scores_do_not_depend_on_the_batch(documents):
    texts = ["", None, "a b c", "x" * 100_000, "tab\tand\nline", "no\xa0break and \u3000wide", "word " * 5000]
    model = X.Model(np.random.default_rng(2).normal(size=X.BUCKETS).astype(np.float32), -0.5)
    got = {r.id: r.score for r in X.score_toxicity(documents(*texts, clash=True), model).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], model.score(t or ""), abs_tol=1e-9)
        assert 0 <= got[i] <= 1


def naive_score(model, text):
    """Word by word, n-gram by n-gram."""
    values = []
    for word in (w for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if w):
        codes = [ord(c) for c in f" {word} "]
        found = []
        for n in (3, 4, 5, 6):
            for i in range(len(codes) - n + 1):
                h = codes[i] + 1
                for c in codes[i + 1 : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                found.append(float(model.weights[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 14]))
        values.append(sum(found) / len(found))
    logits = [sum(values[i : i + X.SPAN]) / X.SPAN + model.bias for i in range(0, max(1, len(values) - X.STEP), X.STEP)]
    return 1 / (1 + math.exp(-max(logits))) if values else 1 / (1 + math.exp(-model.bias))


def test_scores_against_a_naive_scorer_over_spaces_of_all_kinds(documents):
    """Texts whose words would make up for each other if counted by another rule than the model's."""
    r = random.Random(5)
    model = X.Model(np.random.default_rng(4).normal(size=X.BUCKETS).astype(np.float32), -0.5)
    texts = ["a \xa0 b", "x\xa0y zz", "\x1c\x1d a", "\x85", "q\x85w\u2003e", " ", "\xa0", "İ a", None]
    pieces = ["ab", "Wörd", "x", "İ", " ", "  ", "\xa0", "\u3000", "\t", "\n", "\x0b", "\x1f", "\u2028", "\x85"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(400)]
    batch = model.score_all([t or "" for t in texts])
    got = {x.id: x.score for x in X.score_toxicity(documents(*texts), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == batch[i] == model.score(t or "")
        assert math.isclose(got[i], naive_score(model, t or ""), abs_tol=1e-6)


def test_letters_that_grow_in_lower_case(documents):
    texts = ["İİİ İstanbul word", "İ" * 50 + " blockhead", "plain", None, "İyi günler İzmir İyi word"]
    model = X.Model(np.random.default_rng(3).normal(size=X.BUCKETS).astype(np.float32), -0.5)
    got = {r.id: r.score for r in X.score_toxicity(documents(*texts), model).collect()}
    for i, t in enumerate(texts):
        # Lower-cased beforehand, a text keeps its length.
        assert math.isclose(got[i], model.score((t or "").lower()), abs_tol=1e-9)


def test_fit_without_labels_is_neutral(documents, no_documents, spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = X.fit(documents("a", "b", "c"), labels)
    assert model.score("anything") < 0.5
    assert X.score_toxicity(no_documents, model).collect() == []


def test_held_out_follows_the_checksum(spark):
    got = spark.range(200).select("id", X.held_out(X.F.col("id")).alias("h")).collect()
    assert all(r.h == (X.crc_remainder(r.id) == 1) for r in got)


# -- URLs ------------------------------------------------------------------------------------------


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host, tail[:stop]


def ruled(host, path):
    hits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(hits, key=lambda r: len(r[0])) if hits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "http://a.com", "http://a.com/x", "https://notcom/x",
    "http://example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/2?x=/y", "http://xexample.com/en/",
    "http://a.net/es/1", "http://a.net/fr/2#top", "http://a.net/de/3", "http://NET/es/x", "ftp://É.Example.COM/en/a",
    "http://h?q://x/y", "http://a.b.org/" + "/".join(map(str, range(40))), "x://y/" + "z" * 5000, "http://a.org//en///7.html",
]


def test_urls_and_rules(spark):
    data = [*enumerate(URLS), (5, URLS[5]), (None, URLS[6])]
    df = spark.createDataFrame([(i, u, "html", "clash", "clash") for i, u in data], "page_id long, url string, html string, host string, id string")
    got = U.filter_urls(df).collect()
    want = []
    for i, u in data:
        host, path = parsed(u)
        rule, verdict = ruled(host, path)
        want.append((str(i), host, path, rule, verdict))
    assert sorted((str(r.id), r.host, r.path, r.rule or "") for r in got) == sorted((*w[:3], w[3] or "") for w in want)
    by_id = defaultdict(set)
    for w in want:
        by_id[w[0]].add(w[4])
    assert all(r.verdict in ("allow", "block") for r in got)
    assert all(r.rule is None or r.verdict in by_id[str(r.id)] for r in got)


def test_templates_learn_from_labelled_siblings(spark):
    urls = [f"http://h.net/es/{i}" for i in range(30)] + [f"http://h.net/de/{i}" for i in range(5)]
    urls += [f"http://o.org/es/{i}" for i in range(5)] + [f"http://o.org/de/{i}" for i in range(5)]
    urls += [f"http://w.org/name{i}x/page" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.id: r for r in U.filter_urls(df).collect()}
    assert {got[i].verdict for i in range(35, 40)} == {"block"}  # blocked under that template elsewhere
    assert {got[i].template for i in range(45, 85)} == {"*/page"}
    assert got[0].template == "es/{n}"


def test_deep_paths_keep_all_their_segments(spark):
    deep = "/".join(f"s{i}" for i in range(12))
    urls = [f"http://a.org/{deep}/{end}" for end in "abc"] + ["http://a.org/" + "x/" * 3000, "http://a.org//x///y", "http://a.org/x/y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.id: r.template for r in U.filter_urls(df).collect()}
    assert [got[i] for i in range(3)] == [f"{deep}/{end}" for end in "abc"]
    assert got[3] == "/".join("x" * 3000) and got[4] == got[5] == "x/y"


def test_repeated_rows_change_no_template(spark):
    urls = [f"http://a.org/user-{i}/page" for i in range(40)] + ["http://a.org/about", "http://b.org/user-1/page"]
    once = U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    often = U.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls) for _ in range(1 + i % 5)], "page_id long, url string"))
    templates = {r.id: r.template for r in once.collect()}
    assert templates[0] == "*/page" and templates[41] == "user-1/page"
    assert {r.id: r.template for r in often.collect()} == templates


def test_urls_of_nothing(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


# -- licences --------------------------------------------------------------------------------------


def brute_license(text):
    best, matches, names = (0.0, None, None, None), 0, set()
    lines = L.normalised_lines(text or "")
    units = []
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            one = a == b and lines[a]
            full = all(lines[a : b + 1]) and b > a
            paragraph = full and (a == 0 or not lines[a - 1]) and (b == len(lines) - 1 or not lines[b + 1])
            filled = [k for k, line in enumerate(lines) if line]
            whole = filled and (a, b) == (filled[0], filled[-1])
            if one or paragraph or whole:
                units.append((a, b, [w for line in lines[a : b + 1] for w in line]))
    for a, b, words in units:
        own, top = L.bigrams(words), None
        for name, template in L.TEMPLATES:
            other = L.bigrams([w for line in L.normalised_lines(template) for w in line])
            dice = 2 * len(own & other) / (len(own) + len(other))
            if dice >= L.THRESHOLD and (top is None or (-dice, name) < (-top[0], top[1])):
                top = (dice, name)
        if top:
            matches += 1
            names.add(top[1])
            if (-top[0], top[1], a, b) < (-best[0], best[1] or "~", -1 if best[2] is None else best[2], -1 if best[3] is None else best[3]):
                best = (*top, a, b)
    return best[1], round(best[0], 9), matches, ",".join(sorted(names)), best[2], best[3]


def test_license_scan_against_brute_force(documents):
    mit, gpl = L.TEMPLATES[-1][1], L.TEMPLATES[9][1]
    texts = [
        "", None, "plain prose\nof two lines", "Some words.\nReleased under the MIT License.", "Copyright (c) 2020 A. Holder\n" + mit, mit.upper(),
        mit.replace("software", "program", 2) + "\n\nmore prose here", gpl + "\n\n" + mit, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
        "word\n" * 200, "x " * 50_000, "This work is licensed under the GNU General Public License, version 2.",
    ]
    got = L.scan_licenses(documents(*texts, (4, texts[4]), (None, texts[3]), clash=True)).collect()
    want = [(str(i), *brute_license(t)) for i, t in [*enumerate(texts), (4, texts[4]), (None, texts[3])]]
    have = [(str(r.id), r.license, round(r.dice, 9), r.n_matches, r.licenses, r.first_line, r.last_line) for r in got]
    order = lambda rows: sorted(rows, key=str)
    assert order(have) == order(want)
    assert {r.id: r.license for r in got}[4] == "MIT"


MIT_PARAGRAPHS = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
PROSE = "\n".join(f"Line {i} of a manual that tells in the usual words what part {i} is for." for i in range(60))
GPL_HEADER = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_licenses_of_several_paragraphs_in_longer_texts(documents):
    bsd = L.TEMPLATES[2][1].replace(" 1. R", "\n\n1. R").replace(" 2. R", "\n\n2. R").replace(" THIS S", "\n\nTHIS S")
    apache = L.TEMPLATES[1][1].replace(" You may", "\n *\n * You may").replace("\nUnless", "\n *\n * Unless")
    texts = [
        f"{PROSE}\n\n{MIT_PARAGRAPHS}\n\n{PROSE}", f"{PROSE}\n\n{bsd}\n{PROSE}", GPL_HEADER, f"/*\n{GPL_HEADER}\n */\nint main() {{\n{PROSE}",
        f"# tool\n{apache}\nimport os\n{PROSE}", "Released under the MIT License. import os and more code right here",
        "Copyright (c) 2020 A. Holder. Licensed under the MIT License.",
        "Copyright (c) 2019-2021 Some Holder, Inc. " + " ".join(MIT_PARAGRAPHS.split()) + " " + " ".join(PROSE.split()), PROSE,
    ]
    got = {r.id: r for r in L.scan_licenses(documents(*texts)).collect()}
    assert [got[i].license for i in range(9)] == ["MIT", "BSD-2-Clause", "GPL-3.0", "GPL-3.0", "Apache-2.0", "MIT", "MIT", "MIT", None]
    assert (got[0].first_line, got[0].last_line, got[0].n_matches, got[0].dice) == (61, 72, 1, 1.0)
    assert got[1].dice > 0.99 and got[2].dice > 0.9


def test_windows_are_those_of_brute_force():
    r = random.Random(12)
    short = (("A", "one two three four five six seven eight nine ten"), ("B", "red green blue white"))
    known = L.Templates(short)
    for _ in range(60):
        own = short[r.randrange(2)][1].split()
        if r.random() < 0.5:
            own[r.randrange(len(own))] = "other"
        words = [*r.choices(["one", "two", "red", "x", "y"], k=r.randrange(12)), *own, *r.choices(["ten", "blue", "x", "z"], k=r.randrange(12))]
        best = max(
            2 * len(L.bigrams(words[a:b]) & L.bigrams(t.split())) / (len(L.bigrams(words[a:b])) + len(L.bigrams(t.split())))
            for _, t in short for a in range(len(words)) for b in range(a + 2, len(words) + 1)
        )
        # Words dealt to lines, so that no line or paragraph is the unit.
        found = max((m[0] for m in known.matches(" ".join(words))), default=0.0)
        assert (found >= 0.9) == (best >= 0.9)


def test_licenses_of_nothing(no_documents):
    assert L.scan_licenses(no_documents).collect() == []
