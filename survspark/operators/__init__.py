"""DataFrame -> DataFrame operators (survival curves, scans, concordance, encoders, metrics, models)."""
