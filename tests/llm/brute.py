"""Plain Python versions of the operators, one document at a time."""

import hashlib
import itertools
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_duplicates(docs, n, num, den):
    """docs: (doc_id, text). Rows of (doc_id, n_shingles, component_id), in the order given."""
    sets = [shingles(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)]


def contamination(docs, items):
    wins = []
    for item_id, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        m = min(10, len(w))
        wins += [(item_id, w[k : k + m]) for k in range(len(w) - m + 1)] if w else []
    out = []
    for i, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for item_id, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(item_id))
        names = ",".join(sorted(ids))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    repeated = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge_url(url, rules):
    host, path = host_path(url)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def turns_digest(turns):
    """turns: (role, text) in order."""
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    esc_role = lambda s: esc(s).replace("\n", "<\\n")
    pieces = [f"<|im_start|>{esc_role(r)}\n{esc(t)}<|im_end|>\n" for r, t in turns]
    reply = "".join(t for r, t in turns if r == "assistant")
    ends = [k for k, (r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1]
    return (
        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(reply),
        hashlib.sha256(reply.encode()).hexdigest(), sum(len("".join(pieces[: k + 1])) for k in ends),
    )


def crc32(raw):
    return zlib.crc32(raw)
