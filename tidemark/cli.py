"""Command line: ``python -m tidemark.cli sync|origins``; exit code 1 on an abort."""

from __future__ import annotations

import argparse
import os
import sys


def _tell_ci(**flags) -> None:
    """Step outputs for a CI runner, where it names a file for them."""
    path = os.environ.get("GITHUB_OUTPUT")
    if path:
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(f"{k}={str(v).lower() if isinstance(v, bool) else v}\n" for k, v in flags.items())


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync", help="read the documents of one version and update the dataset")
    s.add_argument("--data", required=True)
    where = s.add_mutually_exclusive_group(required=True)
    where.add_argument("--offline", help="folder that holds the documents")
    where.add_argument("--remote", help="url of a document, with {version} and {path}")
    s.add_argument("--head", help="url of a JSON document whose sha is the newest version")
    s.add_argument("--sha", help="the version, in place of the newest one")
    s.add_argument("--today")
    s.add_argument("--changelog")
    s.add_argument("--force", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    o = sub.add_parser("origins", help="match the dataset against a catalogue")
    o.add_argument("--data", required=True)
    o.add_argument("--catalog", required=True, help="file or url of the catalogue")
    args = top.parse_args(argv)

    from .operators.guards import Abort
    from .operators.match import OriginError
    from .plans.sync import UnknownSchema, resolve_origins, sync
    from .session import local_session
    from .sources.files import SourceError
    from .sources.remote import Remote

    spark = local_session()
    try:
        if args.command == "origins":
            n, paid, changed = resolve_origins(spark, args.data, args.catalog)
            _tell_ci(origins_changed=changed, origins_count=n)
            print(f"{n} origins ({paid} paid), {'written' if changed else 'unchanged'}")
            return 0
        source = args.offline or Remote(args.remote, args.head)
        out = sync(spark, args.data, source, args.today, args.sha, args.force, args.changelog, args.dry_run)
    except (Abort, OriginError, UnknownSchema, SourceError) as e:
        print(f"aborted: {e}", file=sys.stderr)
        return 1
    _tell_ci(dataset_changed=out.changed, upstream_sha=out.version)
    for w in out.warnings:
        print(f"warning: {w}")
    print("skipped: same version" if out.skipped else f"{out.counts} written: {', '.join(out.written) or 'nothing'}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
