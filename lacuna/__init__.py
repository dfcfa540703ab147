"""lacuna: void finding and catalogue analytics over point sets, as Spark DataFrame plans."""
