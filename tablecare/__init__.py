"""tablecare: cleaning, summarising, joining and testing tabular records on Spark."""
