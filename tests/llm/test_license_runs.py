"""Notices wrapped over several lines."""

import random
import textwrap

from tapewright.llm import license_scan


def index_of(templates, threshold=license_scan.CONTAINMENT):
    return license_scan.TemplateIndex(templates, {}, threshold)


def test_wrapped_notices_are_found():
    for label, text in license_scan.TEMPLATES:
        for width, lead in ((30, ""), (72, "# "), (60, " * ")):
            wrapped = "\n".join(lead + line for line in textwrap.wrap(text, width))
            scanned = license_scan.scan_text(index_of(license_scan.TEMPLATES), f"import os\n\n{wrapped}\n\nprint(1)")
            assert label in scanned[5].split(","), (label, width, scanned)
            assert scanned[7] >= 1 and scanned[8] == 2


def test_short_notices_wrapped_in_running_text():
    index = index_of(license_scan.TEMPLATES)
    words = "some words of a sentence that came before it and go on".split()
    for label, text in license_scan.TEMPLATES:
        parts = text.split()
        for at in range(1, len(parts)):
            lines = [" ".join(words + parts[:at]), " ".join(parts[at:] + words)]
            scanned = license_scan.scan_text(index, "\n".join(["An opening line", *lines, "and a last one"]))
            assert label in scanned[5].split(","), (label, lines, scanned)


def test_runs_end_at_empty_lines_and_at_far_words():
    index = index_of(license_scan.TEMPLATES)
    assert license_scan.scan_text(index, "Released under\n\nthe MIT\n\nLicense.")[7] == 0
    filler = "many other words stand here between them\n" * 5
    assert license_scan.scan_text(index, f"Licensed under\n{filler}the BSD License.")[7] == 0
    assert license_scan.scan_text(index, "Licensed under\nthe BSD License.")[5:] == ("bsd", 1.0, 1, 0)


def test_runs_against_brute_force():
    rng = random.Random(11)
    for threshold in (0.6, 0.9):
        for _ in range(150):
            templates = [(f"l{i}", " ".join(f"t{rng.randint(0, 12)}" for _ in range(rng.randint(1, 8)))) for i in range(4)]
            index = index_of(templates, threshold)
            lines = [[f"t{rng.randint(0, 16)}" for _ in range(rng.choice([0, 1, 2, 3, 5]))] for _ in range(14)]
            want = set()
            for t, (_, full, need) in enumerate(index.templates):
                for k, line in enumerate(lines):
                    if (n := len(full & {w.encode() for w in line})) >= need:
                        want.add((t, k, k, n / len(full)))
                words = [(k, w.encode()) for k, line in enumerate(lines) for w in line]
                shared = lambda x: len(full & {w for _, w in x})  # noqa: B023, E731
                for a in range(len(words)):
                    for b in range(a + 1, min(len(words), a + index.room[t])):
                        x, (first, last) = words[a : b + 1], (words[a][0], words[b][0])
                        if first < last and all(lines[first : last + 1]) and shared(x) >= need and shared(x[1:]) < need and shared(x[:-1]) < need:
                            want.add((t, first, last, shared([w for w in words if first <= w[0] <= last]) / len(full)))
            got = license_scan.matches_of(index, "\n".join(" ".join(line) for line in lines).encode())
            assert sorted(got) == sorted(want)
