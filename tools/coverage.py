"""Prints the table of survey items and the plans that cover them."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.plans import catalogue  # noqa: E402


def main() -> None:
    covered: dict[str, list[str]] = {}
    for name, p in catalogue().items():
        for item in p.covers:
            covered.setdefault(item, []).append(f"`{name}`" + ("" if p.sql else " (rows)"))
    order = lambda i: (re.sub(r"\d", "", i), int(re.sub(r"\D", "", i)))
    print("| Item | Plans |\n|---|---|")
    for item in sorted(covered, key=order):
        print(f"| {item} | {', '.join(covered[item])} |")


if __name__ == "__main__":
    main()
