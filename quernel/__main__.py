"""A console: ``python -m quernel [folder]``; statements end with the line, ``flush`` and ``exit`` as said."""

from __future__ import annotations

import sys

from quernel.plans.engine import Engine
from quernel.session import session, shared_folder


def main(root: str | None, lines=sys.stdin, out=sys.stdout) -> None:
    """Without a folder the tables lie in the session's shared folder."""
    spark = session(master="local[*]")
    engine = Engine(spark, root or f"{shared_folder(spark)}/console")
    for line in lines:
        line = line.strip().rstrip(";")
        if line.lower() in ("exit", "quit"):
            break
        if line:
            result = engine.execute(line)
            print(result.message if result.data is None else result.to_text(), file=out)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else None)
