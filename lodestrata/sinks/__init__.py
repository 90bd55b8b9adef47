"""Writers: JSON/Parquet publishing, content-addressed snapshots, HTML report."""
