"""Command line: ``spark-submit`` or ``python -m shelfcast forecast|export ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shelfcast import ExportConfig, ForecastConfig, load_predictions, run_export, run_forecast


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="shelfcast")
    commands = parser.add_subparsers(dest="command", required=True)

    forecast = commands.add_parser("forecast", help="forecast all stores and products")
    forecast.add_argument("--transactions", required=True, nargs="+")
    forecast.add_argument("--stores", nargs="+")
    forecast.add_argument("--products", nargs="+")
    forecast.add_argument("--out", required=True)
    forecast.add_argument("--run-id")
    forecast.add_argument("--refresh", action="store_true", help="with --run-id and --dense: bring a run over older input up to date, changed chunks only")
    forecast.add_argument("--no-model", action="store_true")
    forecast.add_argument("--dense", action="store_true", help="also write every cell, in chunks and as one table")
    forecast.add_argument("--no-csv", action="store_true", help="with --dense: no CSV copy")
    forecast.add_argument("--top-pairs", type=int, default=ForecastConfig.top_pairs)
    forecast.add_argument("--sample-rate", type=float, default=ForecastConfig.product_sample_rate)
    forecast.add_argument("--extinct-weeks", type=int, default=ForecastConfig.extinct_weeks)
    forecast.add_argument("--chunk-size", type=int, default=ForecastConfig.store_chunk_size)
    forecast.add_argument("--rounds", type=int, default=ForecastConfig.boost_rounds)
    forecast.add_argument("--patience", type=int, default=ForecastConfig.early_stop_rounds)
    forecast.add_argument("--learning-rate", type=float, default=ForecastConfig.learning_rate)
    forecast.add_argument("--leaves", type=int, default=ForecastConfig.num_leaves)
    forecast.add_argument("--max-panel-rows", type=int, default=ForecastConfig.max_panel_rows)
    forecast.add_argument("--horizons", type=int, default=len(ForecastConfig.horizons), help="weeks ahead, from 1")
    forecast.add_argument("--recent-weeks", type=int, default=ForecastConfig.recent_weeks)
    forecast.add_argument("--seed", type=int, default=ForecastConfig.seed)
    forecast.add_argument("--strict-split", action="store_true")
    forecast.add_argument("--min-train-rows", type=int, default=ForecastConfig.min_train_rows)
    forecast.add_argument("--missing-model", choices=("base", "zero"), default=ForecastConfig.missing_model)
    forecast.add_argument("--clip-base", action="store_true")
    forecast.add_argument("--week-anchor", choices=("tuesday", "monday"), default=ForecastConfig.week_anchor)
    forecast.add_argument("--date-format", action="append", default=[], help="tried after the usual ones; may be repeated")

    export = commands.add_parser("export", help="write the integer-coded result")
    export.add_argument("--predictions", required=True, nargs="+", help="a run's folder, one of chunk files, or chunk files")
    export.add_argument("--out", required=True)
    export.add_argument("--size-cap-mb", type=float, default=ExportConfig.size_cap_mb)
    export.add_argument("--head-rows", type=int, default=ExportConfig.head_rows)
    export.add_argument("--row-group-rows", type=int, default=ExportConfig.row_group_rows)
    export.add_argument("--prefer-brotli", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("shelfcast").getOrCreate()
    if args.command == "forecast":
        cfg = ForecastConfig(
            top_pairs=args.top_pairs,
            product_sample_rate=args.sample_rate,
            extinct_weeks=args.extinct_weeks,
            store_chunk_size=args.chunk_size,
            use_model=not args.no_model,
            write_dense=args.dense,
            write_full=args.dense,
            write_csv=args.dense and not args.no_csv,
            boost_rounds=args.rounds,
            early_stop_rounds=args.patience,
            learning_rate=args.learning_rate,
            num_leaves=args.leaves,
            max_panel_rows=args.max_panel_rows,
            horizons=tuple(range(1, args.horizons + 1)),
            recent_weeks=args.recent_weeks,
            seed=args.seed,
            strict_split=args.strict_split,
            min_train_rows=args.min_train_rows,
            missing_model=args.missing_model,
            clip_base=args.clip_base,
            week_anchor=args.week_anchor,
            date_formats=(*ForecastConfig.date_formats, *args.date_format),
        )
        run = run_forecast(
            spark,
            spark.read.parquet(*args.transactions),
            spark.read.parquet(*args.stores) if args.stores else None,
            spark.read.parquet(*args.products) if args.products else None,
            args.out,
            cfg,
            args.run_id,
            refresh=args.refresh,
        )
        run.summary.show(truncate=False)
        run.metrics.show()
        print(run.run_dir)
    else:
        cfg = ExportConfig(
            size_cap_mb=args.size_cap_mb,
            head_rows=args.head_rows,
            row_group_rows=args.row_group_rows,
            prefer_brotli=args.prefer_brotli,
        )
        source = args.predictions[0] if len(args.predictions) == 1 and not args.predictions[0].endswith(".parquet") else args.predictions
        print(run_export(spark, load_predictions(spark, source), args.out, cfg))


if __name__ == "__main__":
    main()
