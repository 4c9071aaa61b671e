import math
import re
from collections import Counter

from tripleloom.llm import divergence as d
from tripleloom.llm.divergence import COMMON_WORDS, divergence

SCHEMA = "doc_id long, text string, lang string, n_words int"
COMMON = {w for words in COMMON_WORDS.values() for w in words.split()}


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many, hit = Counter(runs), set()
    for i, r in enumerate(runs):
        if many[r] > 1:
            hit.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def kind(c):
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if ord(c) > 127:
        return "accented"
    for name, signs in (("digit", "0123456789"), ("space", " \t\x0b\x0c\r"), ("line", "\n"), ("stop", ".,;:'\"()-"),
                        ("shout", "!?"), ("symbol", "#*$%&|<>")):
        if c in signs:
            return name
    return "other"


def distance(p, q):
    n, m = sum(p.values()), sum(q.values())
    out = 0.0
    for k in q | p:
        a, b = p[k] / n, q[k] / m
        out += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
    return math.sqrt(max(out, 0))


def brute(rows):
    chars = {r[0]: Counter(map(kind, r[1] or "")) for r in rows}
    words = {r[0]: Counter(w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") if w.lower() in COMMON) for r in rows}
    known = {r[0]: r[2] if r[2] in COMMON_WORDS else "" for r in rows}
    refs = {}
    for lang in {"", *known.values()}:
        ids = [i for i, k in known.items() if lang in ("", k)]
        refs[lang] = sum((chars[i] for i in ids), Counter()), sum((words[i] for i in ids), Counter())
    out = []
    for i, text, *_ in rows:
        b = base(text)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        jc = distance(chars[i], refs[known[i]][0]) if sum(chars[i].values()) >= d.CHARS_GUARD else None
        jw = distance(words[i], refs[known[i]][1]) if sum(words[i].values()) >= d.WORDS_GUARD else None
        kept = not failed and (jc or 0) <= d.CHARS_LIMIT and (jw or 0) <= d.WORDS_LIMIT
        out.append((i, *b, failed, kept, *(None if x is None else round(x, 6) for x in (jc, jw))))
    return sorted(out)


def got(frame):
    return sorted((*r[:8], *(None if x is None else round(x, 6) for x in r[8:])) for r in frame.collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = got(divergence(docs))
    assert result == brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r for r in result if labels.get(r[0]) == 1 and not r[6]]
    assert sum(r[7] for r in good) >= 0.99 * len(good)


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "l1\nl1\n\n \n l1\nl1", "a\x0bb\x0cc\rd\te",
             "é É ß 日本 #|<> !?", "the of and " * 400, "THE OF and to " * 30 + "...", "w " * 30_000, "(0) [1] {2} \x1c \xa0x",
             "tail blank \n", "a b c d a b c x b c d"]
    rows = [(k, t, lang, 1) for k, (t, lang) in enumerate((t, x) for t in texts for x in ("en", None, "xx"))]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(divergence(frame.repartition(3))) == brute(rows)
    assert divergence(frame.limit(0)).collect() == []


def test_repeats_null_ids_and_plain_spark(spark):
    frame = spark.createDataFrame([(1, "a b", "en", 0), (1, "a b", "en", 0), (None, "a b", "en", 0)], SCHEMA)
    made = divergence(frame)
    assert len(made.collect()) == 3
    plan = made._jdf.queryExecution().toString() + d.measures(frame, ["a"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
