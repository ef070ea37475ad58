"""Plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    w = space_words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(rows):
    """rows: (id, text) -> smallest id of each row's component, by position."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in seen[g])
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            seen[g].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def without_repeats(rows, length=100):
    """rows: (id, text) in order -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(piece)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def contamination(text, items):
    """(words, hit words, ids of items with occurring windows)."""
    w = item_words(text)
    hit, found = set(), set()
    places = defaultdict(lambda: defaultdict(list))
    for item, t in items:
        own = item_words(t)
        if not own:
            continue
        n = min(13, len(own))
        if n not in places:
            for i in range(len(w) - n + 1):
                places[n][tuple(w[i : i + n])].append(i)
        for i in range(len(own) - n + 1):
            for at in places[n].get(tuple(own[i : i + n]), ()):
                hit.update(range(at, at + n))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


BLANKS = " \t\n\x0b\f\r"


def without_shared_lines(rows, least_docs=2, least_chars=10):
    """rows: (id, text) -> (lines, dropped, text that is left) by position; a null id is one document, the last."""
    holders = defaultdict(set)
    split = [(t or "").split("\n") for _, t in rows]
    keys = [[x.strip(BLANKS).translate(LOWER) for x in own] for own in split]
    for (doc, _), own in zip(rows, keys, strict=True):
        for key in own:
            if len(key) >= least_chars:
                holders[key].add((doc is None, doc or 0))
    out = []
    for (doc, _), own, key in zip(rows, split, keys, strict=True):
        left = [x for x, k in zip(own, key, strict=True) if len(holders[k]) < least_docs or min(holders[k]) == (doc is None, doc or 0)]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def aligned(texts, a, b):
    """One dict for each text, from whole texts, token bytes and all overlaps; a, b: the two libraries."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in printable}
    code.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)})
    words = {i: bytes(code[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in code for c in t)}

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs = []
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text, out_type=int) if text else []
        xb = [words[i] for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        data = (" " + (text or "")).encode()
        if b"".join(xb) != data or b"".join(yb) != data:
            x, y, xb, yb = [], [], [], []
        xs, ys = spans(xb), spans(yb)
        cuts = sorted({e for _, e in xs} & {e for _, e in ys})
        groups, low = [], 0
        for cut in cuts:
            one = [i for i, s in zip(x, xs, strict=True) if low <= s[0] and s[1] <= cut]
            two = [i for i, s in zip(y, ys, strict=True) if low <= s[0] and s[1] <= cut]
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
            low = cut
        links = [(i, j) for i, s in zip(x, xs, strict=True) for j, t in zip(y, ys, strict=True) if s[0] < t[1] and t[0] < s[1]]
        docs.append({"n_a": len(x), "n_b": len(y), "n_groups": len(groups), "links": links, "groups": ";".join(groups)})
    count = Counter(pair for d in docs for pair in set(d["links"]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for d in docs:
        links = d.pop("links")
        d["n_links"] = len(links)
        d["n_best"] = sum(count[p] == best[p[0]] for p in links)
        d["count_sum"] = sum(count[p] for p in links)
        d["groups_sha256"] = hashlib.sha256(d["groups"].encode()).hexdigest() if links else ""
    return docs, {p: (n, n == best[p[0]]) for p, n in count.items()}


def linked(rows, introduction):
    """rows: (conv, turn, role, text) -> the rows with text, quotes, links, parent, thread and depth."""
    mark = re.compile(r"^(?:[ \t]{0,3}>)+")

    def parse(text):
        lines = []
        for raw in re.split(r"\r\n|\r|\n", text):
            found = mark.match(raw)
            level = found.group().count(">") if found else 0
            body = re.sub(r"\s+", " ", (raw[found.end() :] if found else raw).lower()).strip(" ")
            lines.append((raw, level, body))
        passages, number, before = {}, 0, -1  # number: (level, places)
        for at, (_, level, body) in enumerate(lines):
            number += body == "" or level != before
            before = level
            if body:
                passages.setdefault(number, (level, []))[1].append(at)
        return lines, passages

    placed = [i for i, r in enumerate(rows) if None not in (r[0], r[1], r[3])]
    parsed = {i: parse(rows[i][3]) for i in placed}
    said = defaultdict(set)  # (conv, text) -> turns
    for i in placed:
        lines, passages = parsed[i]
        for level, places in passages.values():
            if level == 0:
                said[(rows[i][0], " ".join(lines[a][2] for a in places))].add(rows[i][1])
                for a in places:
                    said[(rows[i][0], lines[a][2])].add(rows[i][1])

    def latest(conv, turn, body):
        return max((t for t in said[(conv, body)] if t < turn), default=None)

    facts, parents = {}, defaultdict(lambda: -1)
    for i in placed:
        conv, turn = rows[i][:2]
        lines, passages = parsed[i]
        links, gone, weight = [], set(), Counter()
        quoted = 0
        for number, (level, places) in passages.items():
            if level == 0:
                continue
            quoted += 1
            body = " ".join(lines[a][2] for a in places)
            original = latest(conv, turn, body)
            if original is None:
                votes = Counter()
                for a in places:
                    by = latest(conv, turn, lines[a][2])
                    if by is not None:
                        votes[by] += len(lines[a][2])
                original = max(votes, key=lambda t: (votes[t], t), default=None)
            if original is not None:
                links.append((number, level, original))
                gone.update(places)
                weight[(level, original)] += len(body)
        lowest = min((level for level, _ in weight), default=None)
        parent = max(((n, t) for (level, t), n in weight.items() if level == lowest), default=(0, None))[1]
        text = rows[i][3]
        if links:
            kept = [x[0] for a, x in enumerate(lines) if a not in gone and not (a + 1 in gone and re.search(introduction, x[0]))]
            text = re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", "\n".join(kept))
        facts[i] = (text, quoted, links, parent)
        if parent is not None:
            parents[(conv, turn)] = max(parents[(conv, turn)], parent)
    out = []
    for i, (conv, turn, role, text) in enumerate(rows):
        text, quoted, links, parent = facts.get(i, (text, 0, [], None))
        root, depth = turn, 0
        if quoted:
            while (conv, root) in parents:
                root, depth = parents[(conv, root)], depth + 1
        out.append((conv, turn, role, text, quoted, tuple((level, place, t) for place, level, t in links), parent, root, depth))
    return out
