"""A read-eval-print loop over a catalog: ``python -m rillstone.cli --data-dir data``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .display import rows_text, table_text
from .errors import RillError
from .service import Metrics, Service
from .sql.parser import Select, parse_statement


def run(service: Service, text: str, write=print) -> None:
    """Executes one statement and prints its result, a select's by batch with its metrics after it. Ctrl-C cancels it."""
    try:
        if not isinstance(parse_statement(text), Select):
            write(table_text(service.execute(text)))
            return
        for part in service.batches(text):
            if isinstance(part, Metrics):
                write(f"Input {part.input_rows} rows, output {part.output_rows} rows, done in {(part.end - part.start) / 1000:.3f} seconds.")
            else:
                write(rows_text(*part))
    except RillError as e:
        write(f"error: {e}")
    except KeyboardInterrupt:
        service.spark.sparkContext.cancelAllJobs()
        write("cancelled")


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--data-dir", default="data")
    service = Service(SparkSession.builder.getOrCreate(), args.parse_args().data_dir)
    try:
        while True:
            text = input("> ").strip()
            if text:
                run(service, text)
    except (EOFError, KeyboardInterrupt):
        service.close()


if __name__ == "__main__":
    main()
