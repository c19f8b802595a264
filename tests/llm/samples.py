"""Sample documents for the tests of this folder."""

WORDS = "the of and to in was for on that with by river stone light garden winter copper silent harbour early letter window mountain paper summer bridge morning orchard distant village music little".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 16) % 3 else str((x >> 12) % 97)))
        out.append("\n" if k % 11 == 10 else " ")
    return "".join(out).strip()


def rows():
    """Documents with nulls, blanks, ties, copies, near copies, repeats, a long text and texts beyond ASCII."""
    made = [(i, prose(i, 30 + 7 * (i % 9)), "en", f"s{i % 3}", 1) for i in range(40)]
    passage = prose(999, 60)
    made += [(100 + i, prose(200 + i, 12) + " " + passage + " " + prose(300 + i, 12), "de", "s0", 1) for i in range(6)]
    made += [(200, made[3][1], "en", "s1", 1), (201, made[3][1], None, None, None), (202, made[3][1] + " end", "en", "s2", 1)]
    made += [(300, None, "en", "s0", 0), (301, "", None, "s1", 0), (302, " \t\n\x0b\x0c\r ", "en", None, 0), (303, "one", "fr", "s2", 3)]
    made += [(400, "a" * 1500, "en", "s0", 1), (401, "ab c\n" * 300, "en", "s0", 1), (402, "Été ÀÉ naïve ß 漢字 emoji 😀   İ " * 12, "fr", "s1", 1)]
    made += [(500, prose(5, 4000), "en", "s0", 1)]
    made += [made[0], made[0], (None, prose(77, 50), "en", "s1", 1)]
    made += [(600 + i, f"Printed on {i} page {i} of the daily copper record\n" + prose(600 + i, 25), "en", "s2", 1) for i in range(14)]
    return made
