"""polyquill: a PySpark-native engine that builds and scores multilingual
question-answer benchmarks and prepares the text around them.

Everything is a lazy DataFrame transformation; Python runs only where built-in
expressions cannot express an operator, and then over Arrow batches.
"""

__version__ = "0.1.0"
