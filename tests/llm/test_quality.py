import re
from collections import Counter

from shelfwise.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, lost = len(words), 0
    for line in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        marks, shouts = len(re.findall("[.,;:!?]", line)), line.count("!")
        separators, symbols = sum(x in quality.SEPARATORS for x in w), len(re.findall(r"[#*$%&|<>]", line))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        lost += len(w) * (
            (len(w) >= 8 and not marks)
            or (shouts >= 3 and 2 * shouts >= len(w))
            or (separators >= 2 and 4 * separators >= len(w))
            or (len(w) <= 4 and not marks)
            or any(p in low for p in quality.PHRASES)
            or (symbols >= 3 and 10 * symbols >= sum(map(len, w)))
        )
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed,
            not failed and 100 * lost <= 50 * n, lost)


HARD = [
    "a b c d e f a b c d e f", "x " * 30, "one. two.\none. two.\n\none. two.\r\none. two.", "\n\n\n", "Home | About | Contact",
    "All rights\nreserved", "ALL RIGHTS RESERVED and words to fill the line with text.", "» › • a b", "é è ê | » \x0b x\x0cy",
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "w1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11", "A!! B!! C!! D!! E!! F!! G!! H!! I!! J!!",
    "$$$ a### b*** c%%% plain words after that and more", "cookie", "line without end\ncookie policy here\n" + "good text, here. " * 3,
]


def figures(df):
    return [tuple(r)[:9] for r in df.collect()]


def test_figures_of_hard_and_odd_texts(spark, odd_documents):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, r["text"]) for i, r in enumerate(odd_documents.collect())]
    got = figures(quality.line_quality(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)))
    assert sorted(got) == sorted((i, *brute(t)) for i, t in rows)


def test_figures_of_documents(documents):
    got = figures(quality.line_quality(documents))
    assert sorted(got) == sorted((r["doc_id"], *brute(r["text"])) for r in documents.collect())


def test_clean_text_keeps_the_other_lines(spark, odd_documents, no_documents):
    text = "Good text, it stays.\nHome | About | Contact\n\nMore of it, too.\nAll rights reserved."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")
    clean = {r["doc_id"]: r["clean_text"] for r in quality.line_quality(docs, with_text=True).collect()}
    assert clean == {1: "Good text, it stays.\n\nMore of it, too.", 2: "", 3: ""}
    assert quality.line_quality(odd_documents, with_text=True).count() == odd_documents.count()
    assert quality.line_quality(no_documents).count() == 0


def test_labelled_documents(documents, labels):
    joined = quality.line_quality(documents).join(labels, "doc_id").collect()
    good = [r["kept"] for r in joined if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in joined if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)
