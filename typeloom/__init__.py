"""typeloom: faceted browse, rollups, change batches and lifecycles over typed objects on Spark."""
