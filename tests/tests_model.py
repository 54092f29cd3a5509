"""Small sequential models that tests compare with."""


def packed(text, size=1000, overlap=200):
    out, cur, n = [], [], 0
    for s in text.replace("\n", " ").split(". "):
        s = s.strip()
        if not s:
            continue
        s = s if s.endswith(".") else s + "."
        if n + len(s) > size and cur:
            out.append(" ".join(cur))
            keep, m = [], 0
            for p in reversed(cur):
                if m + len(p) > overlap:
                    break
                keep.insert(0, p)
                m += len(p)
            cur, n = keep, m
        cur.append(s)
        n += len(s)
    return out + ([" ".join(cur)] if cur else [])


def packed_paragraphs(paragraphs, size=1000, overlap=200):
    out, buf, n, section = [], [], 0, None
    done = lambda: out.extend((section, c) for c in packed(" ".join(buf), size, overlap)) if buf else None
    for heading, text in paragraphs:
        text = (text or "").strip()
        if heading:
            done()
            buf, n, section = [], 0, text
        elif text:
            buf.append(text)
            n += len(text)
            if n >= size:
                done()
                keep, m = [], 0
                for p in reversed(buf):
                    if m + len(p) > overlap:
                        break
                    keep.insert(0, p)
                    m += len(p)
                rest = " ".join(keep)
                buf, n = ([rest] if rest else []), len(rest)
    done()
    return out
