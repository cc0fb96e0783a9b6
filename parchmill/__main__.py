"""Text of PDF files to standard output: python -m parchmill [--stats] [--password P] FILE..., a form feed after each page."""

from __future__ import annotations

import argparse
import resource
import sys
import time

from parchmill.kernel import document


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="parchmill", description=__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("--stats", action="store_true", help="pages, seconds, peak memory and warnings to standard error")
    parser.add_argument("--password", default="")
    chosen = parser.parse_args(arguments)
    bad = 0
    for name in chosen.files:
        began = time.perf_counter()
        try:
            with open(name, "rb") as f:
                data = f.read()
        except OSError as e:
            print(f"parchmill: {e}", file=sys.stderr)
            bad = 1
            continue
        doc, result = document.opened(data, document.Options(password=chosen.password))
        if doc is None:
            print(f"parchmill: {name}: {'a password is needed' if result.status == 'ENCRYPTED' else 'this is not a PDF file'}", file=sys.stderr)
            bad = 1
            continue
        pages = 0
        for _, _, text in document.pages_of(doc):
            pages += 1
            sys.stdout.write(text + "\f")
        if chosen.stats:
            print(f"{pages} pages, {time.perf_counter() - began:.3f}s, {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.1f}MB peak", file=sys.stderr)
            for note in doc.pdf.notes.values():
                print(f"warning: {note}", file=sys.stderr)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
