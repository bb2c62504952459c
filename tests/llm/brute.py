"""Plain versions of the operators, for tests on small tables."""

import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def remove_repeats(docs, width):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = {}
    for k, (_, w) in enumerate(words):
        for j in range(len(w) - width + 1):
            seen.setdefault(tuple(w[j:j + width]), []).append((k, j))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for k, j in places:
                gone[k].update(range(j, j + width))
    return sorted((str(i), len(w), len(g), " ".join(x for n, x in enumerate(w) if n not in g)) for (i, w), g in zip(words, gone))


def fingerprint(text, shingle):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def near_duplicates(docs, shingle, bits):
    fp = [fingerprint(t, shingle) for _, t in docs]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), f"{f:016x}", str(least.get(find(i)))) for i, ((d, _), f) in enumerate(zip(docs, fp)))


def contamination(docs, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                names = windows.get(tuple(w[k:k + size]))
                if names:
                    hit.update(range(k, k + size))
                    found |= names
        ids = sorted(str(x) for x in found if x is not None)
        out.append((str(d), len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    """(start, kind, end, value) of the valid base matches."""
    return sorted((m.start(), k, m.end(), m[0]) for k, (p, ok) in enumerate(BASE.values()) for m in re.finditer(p, text or "") if ok(m[0]))


def disclosing_terms(texts, alpha, support):
    import math

    import regex

    texts = [t or "" for t in texts]
    term = regex.compile(r"[\p{L}\p{N}]+")
    n_t, n_e, n_te, lines = {}, {}, {}, {}
    for t in texts:
        for w in set(term.findall(t)):
            n_t[w] = n_t.get(w, 0) + 1
        here_e, here = set(), set()
        for line in t.split("\n"):
            es = {f"{k}:{v.lower() if k == 0 else v if k == 1 else re.sub('[^0-9]', '', v)}" for _, k, _, v in base_spans(line)}
            bare = line
            for p, _ in BASE.values():
                bare = re.sub(p, " ", bare)
            for e in es:
                here_e.add(e)
                for w in set(term.findall(bare)):
                    here.add((e, w))
                    lines.setdefault((e, w), set()).add(line)
        for e in here_e:
            n_e[e] = n_e.get(e, 0) + 1
        for p in here:
            n_te[p] = n_te.get(p, 0) + 1
    n = len(texts)
    return {w for (e, w), c in n_te.items() if len(lines[e, w]) >= support and n_e[e] < n
            and math.log2(n * c / (n_t[w] * n_e[e])) >= -math.log2(n_e[e] / n) / alpha - 1e-9}


def all_spans(text, terms):
    import regex

    base = base_spans(text)
    extra = [(m.start(), 4, m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{N}]+", text or "") if m[0] in terms]
    return sorted(base + [t for t in extra if not any(t[0] < b[2] and b[0] < t[2] for b in base)])


def redact(text, spans):
    names, out, at = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"], [], 0
    for a, k, b, v in spans:
        if a >= at:
            out += [text[at:a], names[k] if k < 4 else "[NUMBER]" if v.isnumeric() else "[WORD]"]
            at = b
    return text if not spans else "".join(out) + text[at:]


def conversations(rows):
    """(conv, turn, reply_to, root, depth, n_quotes, text) from (conv, turn, text)."""
    def parse(t):
        out = []
        for line in re.split("\r?\n", t or ""):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            out.append((m[1].count(">"), line[m.end():]) if m else (0, line))
        return out

    def led(lines, i):
        return i + 1 < len(lines) and lines[i + 1][0] > lines[i][0] and re.match(r"(?i)^.*\bwrote:\s*$", lines[i][1])

    def norm(b):
        return re.sub(r"[ \t-\r]+", " ", b.lower()).strip(" ")

    def passages(lines):
        """(level, lines) of consecutive lines of one level, attributions out."""
        out = []
        for level, b in [x for i, x in enumerate(lines) if not led(lines, i)]:
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(norm(b))
        return out

    parsed = [(c, t, parse(x)) for c, t, x in rows]
    says = {}
    for c, t, lines in parsed:
        own = [p for level, p in passages(lines) if not level]
        spoken = [[b for p in own for b in p]] + own + [[b] for p in own for b in p]
        for p in own:
            spoken += [part.split("\n") for part in re.split("\n\n+", "\n".join(p))]
        for p in spoken:
            if any(p):
                says.setdefault((c, "\n".join(filter(None, p))), set()).add(t)

    def origin(c, t, p):
        return max((u for u in says.get((c, p), ()) if u is not None and u < t), default=None)

    reply = {}
    for c, t in {(c, t) for c, t, _ in parsed if c is not None and t is not None}:
        n, units = {}, set()
        for cc, tt, lines in parsed:
            if (cc, tt) == (c, t):
                for level, p in passages(lines):
                    p = [b for b in p if b]
                    if level == 1 and p:
                        units |= {("\n".join(p), len(set(p)))} if origin(c, t, "\n".join(p)) is not None else {(b, 1) for b in p}
        for p, k in units:
            o = origin(c, t, p)
            if o is not None:
                n[o] = n.get(o, 0) + k
        if n:
            reply[c, t] = (max(n, key=lambda o: (n[o], o)), sum(n.values()))
    out = []
    for c, t, lines in parsed:
        own = [b for i, (level, b) in enumerate(lines) if not level and not (led(lines, i))]
        root, depth = t, 0
        while (c, root) in reply:
            root, depth = reply[c, root][0], depth + 1
        out.append((str(c), str(t), str(reply.get((c, t), (None,))[0]), str(root), depth, reply.get((c, t), (0, 0))[1], "\n".join(own).strip("\n")))
    return sorted(out)


def licence_hits(text, templates, threshold):
    def grams(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        return set(zip(w, w[1:]))
    known = sorted((n, grams(t)) for n, t in templates.items())
    body = (text or "").lower()
    lines = re.sub(r"\n[ \t\r]*\n\s*", "\n", body).split("\n")
    paragraphs = re.split(r"\n[ \t\r]*\n\s*", body)
    pieces = [(0, i, x) for i, x in enumerate(lines)] + [(1, i, x) for i, x in enumerate(paragraphs) if len(paragraphs) > 1] + [(2, 0, body)] * (len(lines) > 1)
    out = []
    for u, i, x in pieces:
        g = grams(x)
        best = max(((2 * len(g & t) / (len(g) + len(t)) if g else 0.0), -k, n) for k, (n, t) in enumerate(known))
        if best[0] >= threshold - 1e-12:
            out.append((round(best[0], 9), best[2], u, i))
    return out


def prefix_nodes(rows):
    """Operator 11's query on (conv_id, turn, role, text) rows: rebuilt
    conversations and the trie of their prefixes, node by node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + said[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[:len(node)] == node]
        childless = [x for x in below if not any(y[:-1] == x for y in nodes if y)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                    sum(bool(x) and x[:-1] == node for x in nodes), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cheapest_edits(turns):
    """(cost, audit, repaired turns) of (role, text, fault) turns, by a table
    of the best (cost, letters) per state and turn."""
    def relax(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
                best[to] = min(best.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
        return best

    best = {"": (0, "")}
    for role, _, fault in turns:
        nxt, i = {}, role[:1]

        def offer(q, c, a):
            nxt[q] = min(nxt.get(q, (c, a)), (c, a))

        for q, (c, a) in relax(best).items():
            offer(q, c + 4, a + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (i == "s" and q == "") or (i == "u" and q in ("", "s", "a")) or (i == "a" and q == "u"):
                    offer(i, c + more, a + "K")
                offer("a" if q == "u" else "u", c + more + 3, a + "R")
        best = nxt
    best = relax(best)
    cost, audit = min(best[q] for q in ("", "a") if q in best)
    out, rows, state = [], iter(turns), ""
    for letter in audit:
        role, text, _ = ("", "", None) if letter == "I" else next(rows)
        if letter != "D":
            state = role[:1] if letter == "K" else "a" if state == "u" else "u"
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state], text))
    return cost, audit, out


def repairs(rows):
    """Operator 13's query on (conv_id, turn, role, text) rows."""
    kept, convs = {}, set()
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        convs.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            row = (turn is not None, turn or 0, "user" if kind == 4 else role), hashlib.md5(text.encode()).hexdigest(), text
            kept.setdefault(conv, []).extend([(*row[0], *row[1:])] * (2 if kind == 3 else 1))
    out = []
    for conv in convs:
        mine, seen, turns, n = sorted(kept.get(conv, [])), set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in mine:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t for there, t, *_ in mine if there}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, fixed = cheapest_edits(turns)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in fixed))))
    return sorted(out)
