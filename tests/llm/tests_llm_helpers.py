"""Plain Python versions that several tests use."""

import collections
import math
import re

from murmura.llm import secrets


def spans_of(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.BASE["assign"][0], t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    for m in re.finditer(secrets.CANDIDATE, t):
        if re.fullmatch(r"[A-Z]?[a-z]+([/_=+-]+[A-Z]?[a-z]+)*[/_=+-]*", m[0]):
            continue
        own = m[0]
        for p in secrets.ALLOW:
            own = re.sub(p, lambda x: "-" * len(x[0]), own)
        bits = next(b for p, b in secrets.CLASSES.values() if re.search(p, own))
        w = secrets.WINDOW
        entropy = [-sum(c / w * math.log2(c / w) for c in collections.Counter(own[i : i + w]).values()) for i in range(len(own) - w + 1)]
        if ok := [i for i, e in enumerate(entropy) if e >= bits - 1e-12]:
            out.append((m.start() + ok[0], 3, m.start() + ok[-1] + w))
    return sorted(out)
