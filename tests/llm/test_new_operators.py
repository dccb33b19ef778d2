"""Chat formatting, periodic runs and centroid clustering, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import centroid_clustering, chat_format, periodic_runs, queries
from timberline.llm.chat_format import INSTRUCT
from timberline.llm.templates import Const, If, Template, TemplateError, Write

# -- periodic runs ----------------------------------------------------------------------------


def runs_by_hand(w, least=6, power=4):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, power * q) and not any(
                all(w[t] == w[t + p] for t in range(i, i + n - p)) for p in range(1, q)
            ):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    draw = random.Random(7)
    for _ in range(1500):
        w = [draw.randrange(draw.choice([1, 2, 2, 3, 5])) for _ in range(draw.randint(0, 70))]
        if w and draw.random() < 0.6:
            a, p = draw.randrange(len(w)), draw.randint(1, max(1, len(w) // 4))
            for i in range(a, len(w)):
                w[i] = w[a + (i - a) % p]
        assert list(map(tuple, periodic_runs.periodic_runs(w).tolist())) == runs_by_hand(w)


def test_runs_of_other_strengths():
    w = [0, 1, 0, 1, 2, 2, 2]
    assert periodic_runs.periodic_runs(w, least=3, power=2).tolist() == [[0, 4, 2], [4, 3, 1]]
    assert periodic_runs.periodic_runs([], least=1, power=2).tolist() == []


TEXTS = [
    None, "", " \t\n", "one", "a " * 5, "a " * 6, "x " + "a b " * 4 + "y", "a b c " * 4 + "a b", "na na " * 7, "A a " * 3,
    "a b a b a b a b c c c c c c c", "w " * 50_000, " ".join(str(i % 700) for i in range(20_000)), "é ü " * 8,
]
DOC_COLUMNS = "doc_id bigint, text string, runs string, n_words string, collapsed int, w string, h int, a int"


def doc_rows():
    rows = [(i, t, "r", "n", 1, "w", 2, 3) for i, t in enumerate(TEXTS)]
    return rows + [rows[7], (None, "b " * 9, None, None, None, None, None, None)]


def words_of(text):
    return (text or "").encode().split()


def test_find_runs(spark):
    docs = spark.createDataFrame(doc_rows(), DOC_COLUMNS)
    found = periodic_runs.find_runs(docs).collect()
    assert len(found) == len(doc_rows())
    text_of = dict(enumerate(TEXTS)) | {None: "b " * 9}
    for r in found:
        w = words_of(text_of[r.doc_id])
        expected = runs_by_hand(w) if len(w) < 100 else {11: [(0, 50_000, 1)], 12: [(0, 20_000, 700)]}[r.doc_id]
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(w)
        assert r.collapsed.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_groups_do_not_change_runs():
    lists = [words_of(t) for t in TEXTS[:11]]
    for size in (1, 3, 11):
        found = [x for i in range(0, 11, size) for x in periodic_runs._of_group(lists[i:i + size], 6, 4)]
        assert [rows.tolist() for rows, _ in found] == [[list(r) for r in runs_by_hand(w)] for w in lists]


def test_periodic_runs_query(spark, tmp_path):
    """The query's planted texts and digests, on ids that hit every remainder."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefgh") * draw.randint(1, 2) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), rows[3], (None, "z " * 8)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc, text in rows:
        w = words_of(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, first = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [first[i] if i < a else first[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((
            doc, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        ))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150)) and any(e[2] for e in expected)
    found = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


# -- clustering -------------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, scale, seed, dim):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (
        hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [v for _, v in drawn[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        near = [min((square(v, x), j) for j, x in enumerate(c)) for _, v in kept]
        if step < rounds:
            groups = [[v for (_, v), (_, j) in zip(kept, near) if j == g] for g in range(len(c))]
            c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, near)), key=repr), c


VECTOR_COLUMNS = "vec_id bigint, embedding array<float>, label int, cluster string, v string, bound string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "v", "b") for i, v in rows], VECTOR_COLUMNS)


def awkward_vectors():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 4)) * 3
    rows = [(i, (centres[i % 6] + draw.normal(size=4) * 0.5).tolist()) for i in range(240)]
    rows += [(900 + i, [float(i % 2), 0.0, 0.0, 1.0]) for i in range(20)]  # ties and equal vectors
    rows += [rows[0], (0, rows[5][1]), (None, rows[6][1])]
    return rows + [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 1.0, 1.0]), (1004, [float("nan")] * 4),
                   (1005, [float("inf"), 0.0, 0.0, 0.0]), (1006, [1.0] * 5)]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_clusters(spark, k):
    rows = awkward_vectors()
    found = centroid_clustering.cluster(vectors(spark, rows), k=k, rounds=5, dim=4)
    expected, centroids = clusters_by_hand(rows, k, 5, 1024, 3, 4)
    assert sorted(map(tuple, found.assigned.collect()), key=repr) == expected
    assert found.centroids == centroids and sum(found.sizes) == len(expected)
    assert found.inertia == [sum(d for _, c, d in expected if c == j) for j in range(k)]


def test_clusters_of_few_or_no_vectors(spark):
    none = centroid_clustering.cluster(vectors(spark, []), dim=4)
    assert none.assigned.count() == 0 and none.centroids == []
    two = centroid_clustering.cluster(vectors(spark, [(1, [0.0] * 4), (2, [0.0] * 4), (3, None)]), dim=4)
    assert sorted(map(tuple, two.assigned.collect())) == [(1, 0, 0), (2, 0, 0)] and two.sizes == [2, 0]
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.cluster(vectors(spark, [(1, [1e9] * 4)]), dim=4)


def test_loosening_holds_and_saves_scans(spark):
    draw = np.random.default_rng(1)
    for _ in range(100):
        c = draw.integers(-200, 200, (4, 3))
        moved, radii = c + draw.integers(-30, 30, (4, 3)), draw.uniform(0, 150, 4)
        bound, full = centroid_clustering.loosening(c, moved, radii), centroid_clustering.full_drift(c, moved, radii)
        assert (bound <= full + 1e-6).all()
        for i in range(4):
            p = draw.normal(size=(2000, 3))
            p = c[i] + p / np.linalg.norm(p, axis=1)[:, None] * radii[i] * draw.uniform(0, 1, (2000, 1)) ** 0.2
            for j in set(range(4)) - {i}:
                mine = p[np.linalg.norm(p - c[i], axis=1) <= np.linalg.norm(p - c[j], axis=1)]
                shrunk = np.linalg.norm(mine - c[j], axis=1) - np.linalg.norm(mine - moved[j], axis=1)
                assert not len(mine) or shrunk.max() <= bound[i, j] + 1e-9
    rows = vectors(spark, awkward_vectors())
    tight = centroid_clustering.cluster(rows, dim=4)
    plain = centroid_clustering.cluster(rows, dim=4, loosen=centroid_clustering.full_drift)
    assert tight.centroids == plain.centroids
    assert sum(tight.scanned) < sum(plain.scanned) < 11 * sum(tight.sizes)


# -- templates --------------------------------------------------------------------------------


class Text:
    def __init__(self):
        self.out, self.learned = "", []

    def write(self, piece, masked):
        self.out += piece
        if masked:
            self.learned[-1] += piece

    def masked(self, start):
        if start:
            self.learned.append("")


def rendered(source, constants=None, **variables):
    sink = Text()
    Template(source, constants).render(sink, **variables)
    return sink.out


@pytest.mark.parametrize("source, expected", [
    ("a{# note }} #}b", "ab"), ("  {{- x -}}  ", "5"), ("{{ '}}' ~ \"%}\" }}", "}}%}"), ("{{ 1 + 2 * 3 - 4 // 3 }}", "6"), ("{{ -7 % 3 }}", "2"),
    ("{{ (1 + 2) * 3 }}", "9"), ("{{ 'a' + 'b' }}", "ab"), ("{{ x == 5 and not none }}", "true"), ("{{ none or 'else' }}", "else"),
    ("{{ 'y' if x > 4 else 'n' }}", "y"), ("{{ 'y' if x > 9 }}", ""), ("{{ m.a ~ m['b'] ~ m.c }}", "12"), ("{{ l[0] ~ l[-1] ~ l[9] }}", "pr"),
    ("{{ 'q' in l }}{{ 'z' not in l }}{{ 'a' in m }}", "truetruetrue"), ("{{ y is defined }}{{ x is not none }}", "falsetrue"),
    ("{% for i in l %}{{ loop.index }}{{ i }}{{ ',' if not loop.last }}{% endfor %}", "1p,2q,3r"), ("{% for i in none %}x{% endfor %}", ""),
    ("{% if x < 3 %}a{% elif x == 5 %}b{% else %}c{% endif %}", "b"), ("{% set z = x + 1 %}{{ z }}{% for i in l %}{% set z = 0 %}{% endfor %}{{ z }}", "66"),
    ("{{ ' a ' | trim | upper }}{{ y | default('d') }}{{ l | length }}{{ 'aba' | replace('a', 'c') }}", "Ad3cbc"),
    ("{{ \"it's\\n\" }}", "it's\n"), ("{{ x.real }}{{ 'a'.upper }}", ""), ("{% if false %}{{ 1 // 0 }}{% endif %}ok", "ok"),
])
def test_template_language(source, expected):
    assert rendered(source, x=5, m={"a": 1, "b": 2}, l=["p", "q", "r"]) == expected


@pytest.mark.parametrize("source", [
    "{{ x", "{% if x %}", "{% endfor %}", "{% for in x %}{% endfor %}", "{{ x | nothing }}", "{{ open('f') }}", "{{ x.f() }}", "{{ 1 2 }}", "{{ }}",
    "{% while x %}", "{{ x ! y }}", "{% set if = 1 %}", "{{ x | replace('a') }}", "{{ m['a' }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}",
])
def test_wrong_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 1 // zero }}", "{{ 'a' * 9 }}", "{{ 'a' < 1 }}", "{{ m }}", "{{ raise_exception('no') }}", "{% for i in 5 %}{% endfor %}", "{{ 1 in 2 }}"])
def test_templates_that_stop(source):
    with pytest.raises(TemplateError):
        rendered(source, zero=0, m={"a": 1})


def test_sandbox_takes_plain_data_only():
    with pytest.raises(TemplateError):
        rendered("{{ x.out }}", x=Text())
    assert rendered("{{ x.__class__ }}{{ x['__class__'] }}", x="a") == ""


def test_folding():
    made = Template("a{{ '<' ~ bos ~ '>' }}{% if big > 2 %}b{% else %}c{% endif %}{{ 'x' | upper }}{{ 'k' if none else 'l' }}", {"bos": "s", "big": 3})
    assert made.tree == (Write(Const("a<s>bXl")),)
    kept = Template("{% if x %}{{ 1 + 1 }}{% endif %}").tree
    assert len(kept) == 1 and isinstance(kept[0], If) and kept[0].yes == (Write(Const("2")),)
    assert Template("{% for m in messages %}{{ m.a }}{% endfor %}").streams("messages")
    assert not Template("{{ messages[0] }}{% for m in messages %}{% endfor %}").streams("messages")
    assert not Template("{% for a in x %}{% for m in messages %}{% endfor %}{% endfor %}").streams("messages")


def test_escapes_are_reversible():
    form, draw = INSTRUCT.compiled(), random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice(["<", "s>", "/s>", "</s>", "[INST]", "[", "/INST]", "\\", "\\\\", "a", "\n", "]"]) for _ in range(draw.randint(0, 9)))
        escaped = form.escape(text)
        assert form.unescape(escaped) == text and not any(c in escaped for c in form.ends)
        assert chat_format.from_one_line(chat_format.one_line(text)) == text and "\n" not in chat_format.one_line(text)


SAID = [
    (1, 0, "system", "be <s>brief</s>"), (1, 1, "user", None), (1, 2, "assistant", "ok \\ [/INST] é😀"), (1, 3, "user", "<\\s>"), (1, 4, "assistant", ""),
    (2, 1, "assistant", "last"), (2, 0, "tool\n[INST]\\n", "[INST"), (2, None, None, " [/INST]"), (None, 0, "user", "who"), (3, 0, "user", "x" * 100_000),
    (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (5, 0, "user", "only"), (6, 0, "assistant", "a<"), (6, 1, "assistant", "/s>"),
]
SAID_COLUMNS = "conv_id bigint, turn bigint, role string, text string, formatted string, learned int, n_turns string"


def said(spark):
    return spark.createDataFrame([(*r, "f", 1, "n") for r in SAID], SAID_COLUMNS).repartition(5)


def test_conversations(spark):
    convs = {}
    for conv, turn, role, text in SAID:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.digests(said(spark)).collect()}
    whole = {r.conv_id: r for r in chat_format.formatted(said(spark)).collect()}
    assert got.keys() == whole.keys() == convs.keys()
    form = INSTRUCT.compiled()
    for conv, turns in convs.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        r, out = got[conv], whole[conv]
        learned = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == len(out.formatted)
        assert [form.unescape(out.formatted[a:b]) for a, b in out.learned] == [text for role, text in turns if role == "assistant"]
    assert whole[1].formatted.startswith("[INST] system\nbe <\\s>brief<\\/s> [/INST][INST] user\n [/INST]<s>assistant\nok ")
    assert chat_format.digests(said(spark).limit(0)).count() == 0


def test_another_template(spark):
    """A template that looks ahead is given the whole list, and one with other marks reads back as well."""
    form = chat_format.Format(
        "{{ messages | length }}{% for m in messages %}{{ '<|im|>' ~ m.role }}:{% generation %}{{ m.text | escape }}{% endgeneration %}<|end|>{% endfor %}",
        ("<|im|>", "<|end|>"), r"\d*<\|im\|>(?P<role>.*?):(?P<text>.*?)<\|end\|>",
    )
    rows = spark.createDataFrame([(1, 0, "a", "x<|end|>"), (1, 1, "b", "y")], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.formatted(rows, form).first().formatted == "2<|im|>a:x<\\|end|><|end|><|im|>b:y<|end|>"
    found = chat_format.digests(rows, form).first()
    assert (found.n_turns, found.turns_sha256) == (2, hashlib.sha256(b"a\nx<|end|>\nb\ny\n").hexdigest())
    with pytest.raises(TemplateError):
        chat_format.Format("", ("<a<",), "").compiled()


def test_long_conversation_streams(spark):
    rows = spark.range(30_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    )
    found = chat_format.digests(rows).first()
    assert found.n_turns == 30_000 and found.loss_chars == sum(len(str(i)) for i in range(1, 30_000, 2))
