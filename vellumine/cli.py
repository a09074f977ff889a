"""Command line: one document to Markdown, without a Spark session."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import BinaryIO, TextIO

from vellumine import __version__
from vellumine.kernel.convert import convert
from vellumine.kernel.objects import PdfError
from vellumine.sources.files import read_source


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(f"{message}\n{self.format_usage()}")


def _arguments() -> argparse.ArgumentParser:
    p = _Parser(prog="vellumine", description="Convert a PDF file to Markdown.")
    p.add_argument("input", help="path, URL, or - for standard input")
    p.add_argument("-o", "--output", help="file to write instead of standard output")
    p.add_argument("--page-breaks", action="store_true", help="a rule between pages")
    p.add_argument("--extract-images", metavar="FOLDER", help="write images to this folder and link them")
    p.add_argument("-V", "--version", action="version", version=f"vellumine {__version__}")
    return p


def main(argv: Sequence[str] | None = None, stdin: BinaryIO | None = None, stdout: TextIO | None = None, stderr: TextIO | None = None) -> int:
    """0, or 1 after an error, which goes to ``stderr``. Images are written before the Markdown."""
    stdout, stderr = stdout or sys.stdout, stderr or sys.stderr
    try:
        args = _arguments().parse_args(argv)
        markdown, images = convert(read_source(args.input, stdin), args.page_breaks, args.extract_images)
        if args.extract_images is not None:
            folder = Path(args.extract_images)
            folder.mkdir(parents=True, exist_ok=True)
            for name, data in images:
                (folder / name).write_bytes(data)
        if args.output:
            Path(args.output).write_text(markdown, encoding="utf-8", newline="")
        else:
            stdout.write(markdown)
        return 0
    except (OSError, ValueError, PdfError) as e:
        print(f"error: {e}", file=stderr)
        return 1
