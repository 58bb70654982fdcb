"""Analytics over sensor-perception evaluation data, expressed as Spark DataFrame plans."""
