"""Near duplicates against all pairs that share a shingle."""

import random
import re
from collections import defaultdict

from strandloom.llm.near_dedup import near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(pairs):
    sets = {d: shingles(t) for d, t in pairs}
    index, shared, parent = defaultdict(list), defaultdict(int), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            for e in index[x]:
                shared[e, d] += 1
            index[x].append(d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def test_documents(rows, documents):
    assert result(rows(documents)) == brute(documents)


def test_large_group_with_members_about_the_threshold(rows):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    pairs = []
    for d in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        pairs.append((d, " ".join(words)))
    assert result(rows(pairs)) == brute(pairs)


#: word number -> number in its replacement, for texts of the words w0 to w199
EDITS = [
    {75: 93466, 80: 638805, 198: 58360}, {38: 247825, 131: 340819}, {62: 919895, 161: 976922}, {30: 336152, 50: 31695, 129: 823147}, {92: 546616, 135: 499600, 183: 719081, 198: 325865},
    {159: 73456, 168: 111375}, {64: 69950, 123: 458543, 171: 842559}, {115: 232658, 122: 333699, 182: 983627, 197: 438720}, {80: 979284, 136: 389724, 185: 972626, 199: 468550},
    {26: 53533, 71: 967270, 116: 806510, 163: 92128}, {16: 135216, 142: 39192}, {17: 689571, 76: 36830, 158: 717288}, {37: 89863, 87: 808203, 133: 458598, 178: 412993},
]


def test_a_link_that_the_closest_partners_do_not_show(rows):
    pairs = [(d, " ".join(f"x{e[i]}" if i in e else f"w{i}" for i in range(200))) for d, e in enumerate(EDITS)]
    got = result(rows(pairs))
    assert got == brute(pairs)
    assert {c for _, c, _ in got.values()} == {0}


def test_many_small_groups_about_the_threshold(rows):
    rng = random.Random(11)
    pairs = []
    for g in range(60):
        size = rng.choice((40, 80, 200))
        for _ in range(rng.randrange(8, 15)):
            words = [f"g{g}w{i}" for i in range(size)]
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            pairs.append((len(pairs), " ".join(words)))
    assert result(rows(pairs)) == brute(pairs)


def test_odd_rows(rows):
    pairs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (7, "one two three four five"), (8, "y " * 30_000)]
    assert result(rows(pairs)) == brute(pairs)
    repeated = near_duplicates(rows([(9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in repeated) == [("9", "9", True), ("9", "9", True), ("None", "9", False)]
    assert result(rows(pairs).limit(0)) == {}


def test_rows_of_one_id_with_several_texts(rows):
    base = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    pairs = [(5, base("a")), (5, base("b")), (6, base("a", 55)), (7, base("b", 55)), (8, base("c")), (8, base("d"))] + [(20 + i, base("b", 50 + i % 5) + f" x{i}") for i in range(12)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(rows(pairs)).collect()}
    assert got == {(d, 8 if d == 8 else 5) for d, _ in pairs}
