"""Small tables and brute-force versions for the tests of the training-data operators."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# names that operators use for their own results stand beside the real columns
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q string, kept string, size string, target string, score string, toxic string, component_id string"


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, s, None if t is None else len(t), "q", "k", "s", "t", "x", "y", "z") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def odd_rows():
    """Null, empty, blank, very long and repeated texts, null ids, languages and sources."""
    long = " ".join(f"w{n % 977}x{n % 31}" for n in range(60_000))
    base = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long, "en", "a"), (5, "one two three", "en", None),
        (6, "one two three", "en", "b"), (6, "one two three", "en", "b"), (None, "no id here at all", "en", "b"), (None, None, None, None),
    ]
    return base + [(10 + n, f"plain words number {n} and " + " ".join(f"t{n}v{k}" for k in range(70)), "en", "ab"[n % 2]) for n in range(12)]


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text))
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(texts):
    """doc id -> component id, for distinct ids, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return components(ids, links)


def repeated_words(w):
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(map((text or "").count, "#*$%&|<>")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(w),
    }


def gapless(rows, group, start, length):
    by = defaultdict(list)
    for r in rows:
        by[r[group]].append((r[start], r[length]))
    ends = {}
    for g, places in by.items():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        ends[g] = at
    return ends
