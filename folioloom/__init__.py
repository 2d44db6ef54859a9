"""Archive analytics on Spark: ordered page sequences, folio links, provenance, serving views and exports."""
