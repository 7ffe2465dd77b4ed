import math
import random
import re

from lexmill.llm import licences
from lexmill.llm.licences import FILE_SHARE, FUNCTION_WORDS, LEAST_COSINE, TEMPLATES, scan, template_terms


def terms(text):
    return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if t and t not in FUNCTION_WORDS]


def brute(files):
    """Every line, whole file and window against every template; then every ancestor directory."""
    counted = template_terms(TEMPLATES)
    known, of, length = {t for _, t, _ in counted}, {}, {}
    lines = [[x for x in map(terms, (text or "").split("\n")) if x] for _, _, text in files]
    n_lines = sum(map(len, lines))
    df = {t: sum(t in x for own in lines for x in own) for t in known}
    idf = {t: math.log((1 + n_lines) / (1 + df[t])) + 1 for t in known}
    rest = math.log(1 + n_lines) + 1
    for k, t, c in counted:
        of.setdefault(k, {})[t] = c * idf[t]
        length[k] = length.get(k, 0) + c
    for k, ws in of.items():
        norm = math.sqrt(sum(w * w for w in ws.values()))
        of[k] = {t: w / norm for t, w in ws.items()}

    def cosine(words, k):
        tf = {t: words.count(t) for t in set(words) & known}
        sq = sum((idf[t] * c) ** 2 for t, c in tf.items()) + (len(words) - sum(tf.values())) * rest * rest
        return round(sum(idf[t] * c * of[k].get(t, 0) for t, c in tf.items()) / math.sqrt(sq), 9) if tf else 0

    out = []
    for (i, path, text), own in zip(files, lines, strict=True):
        every = [t for x in own for t in x]
        found, covered, wide, whole = [], 0, 0, False
        for x in own:
            best = max((cosine(x, k), -k) for k in of)
            if best[0] >= LEAST_COSINE:
                found.append(best)
                covered += len(x)
        if len(own) > 1:
            best = max((cosine(every, k), -k) for k in of)
            if best[0] >= LEAST_COSINE:
                found.append(best)
                whole = True
        for pos, t in enumerate(every):
            for k in of:
                for n in {length[k], length[k] * 3 // 2} if t in of[k] else ():
                    window = every[pos : pos + n]
                    met = sum(w in known for w in window)
                    got = cosine(window, k) if met > 1 else 0
                    if got >= LEAST_COSINE:
                        found.append((got, -k))
                        wide = max(wide, met)
        best = max(found, default=None)
        named = path is not None and bool(re.search(licences._NAMED, path))
        mostly = whole or max(covered, wide) >= FILE_SHARE * len(every)
        out.append({"id": i, "path": path, "own": TEMPLATES[-best[1]][0] if best else None, "cosine": best[0] if best else None, "file": best is not None and path is not None and (mostly or named)})
    dirs = {}
    for r in out:
        if r["file"]:
            d = r["path"].rpartition("/")[0]
            dirs[d] = min(dirs.get(d, (9,)), (-r["cosine"], r["path"], r["own"]))
    rows = []
    for r in out:
        licence, source = r["own"], r["path"] if r["own"] else None
        if not r["own"] and r["path"] is not None:
            d = r["path"].rpartition("/")[0]
            up = [d, *("/".join(d.split("/")[:k]) for k in range(len(d.split("/")) - 1, -1, -1))]
            near = next((dirs[x] for x in up if x in dirs), None)
            licence, source = (near[2], near[1]) if near else (None, None)
        rows.append((r["id"], r["own"], r["file"], licence, source))
    return sorted(rows, key=str)


def test_scan_by_brute_force(spark):
    rnd = random.Random(13)
    vocab = [f"word{k}" for k in range(60)] + "license software version free work public use copy permission terms general".split()

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    files = []
    for k in range(70):
        text = [prose(rnd.randint(1, 30)) for _ in range(rnd.randint(0, 5))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words = rnd.choice(TEMPLATES)[1].split()
            if rnd.random() < 0.4:
                words[rnd.randrange(len(words))] = "changed"
            shown = " ".join(words) if rnd.random() < 0.5 else "\n".join(" ".join(words[a : a + 4]) for a in range(0, len(words), 4))
            text.insert(rnd.randint(0, len(text)), shown if rnd.random() < 0.6 else prose(6) + " " + " ".join(words) + " " + prose(6))
        folder = rnd.choice(["", "a/", "a/b/", "a/b/c/", "d/", "d/e/"])
        files.append((k, folder + rnd.choice([f"f{k}.py", f"f{k}.txt", f"LICENSE-{k}"]), rnd.choice(["\n", "\n\n"]).join(text)))
    files += [(100, None, "Released under the MIT License."), (101, "z/x.py", None), (102, "z/y.py", ""), (103, "d/e/f/g/h.py", prose(9))]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = sorted(((r.id, r.own_licence, r.is_licence_file, r.licence, r.licence_from) for r in scan(spark, df, "id", "path", "text").collect()), key=str)
    want = brute(files)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r for r in got if r[3] and not r[1]] == [r for r in want if r[3] and not r[1]]
    assert sum(r[1] is not None for r in got) > 20 and sum(r[1] is None and r[3] is not None for r in got) > 5
