"""ruleloom: Spark-native analytics for evaluating rule-governed decisions."""
