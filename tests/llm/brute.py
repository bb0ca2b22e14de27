"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans, names):
    return ",".join(f"{names[k]}:{a}:{z}" for k, a, z in spans)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    found = [[m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]]
    for pattern, least in ((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)):
        found.append([m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least])
    spans = sorted(((k, a, z) for k, part in enumerate(found) for a, z in part), key=lambda s: (s[1], s[0]))
    return *map(len, found), sha(joined(spans, ("assign", "access", "hex")))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def personal(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    found = [[m.span() for m in re.finditer(p, text) if good(m[0])] for p, good in rules]
    spans = [(k, a, z) for k, part in enumerate(found) for a, z in part]
    return *map(len, found), sha(joined(spans, ("email", "ip", "card", "phone")))


def exact(rows):
    """{doc_id: (keep_id, group_size, kept, text_sha256)} of distinct ids."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(WHITE.sub(" ", text or ""), []).append(doc_id)
    return {d: (min(ids), len(ids), d == min(ids), sha(t)) for t, ids in groups.items() for d in ids}


def chats(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        result[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return result


def shingles(text, size=5):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(rows, percent=85):
    """{doc_id: (n_shingles, component_id, kept)}; candidates through an index of all shingles."""
    sets = {d: shingles(t) for d, t in rows}
    index, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for other in index.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            index[s].append(d)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
