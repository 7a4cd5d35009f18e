import sys
from pathlib import Path

for folder in (Path(__file__).resolve().parents[2], Path(__file__).resolve().parents[1]):
    sys.path.insert(0, str(folder))
