"""Brute-force versions that several tests use."""

import xxhash


def brute_print(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    found = {p: p for p in prints}

    def top(p):
        while found[p] != p:
            p = found[p]
        return p

    unique = sorted(set(prints))
    for i, a in enumerate(unique):
        for b in unique[:i]:
            if bin(a ^ b).count("1") <= distance:
                found[top(a)] = top(b)
    return {p: top(p) for p in unique}
