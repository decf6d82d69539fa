import importlib.util
import os
import sys

# the small tables, under a name of their own
_path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "common.py")
_spec = importlib.util.spec_from_file_location("tests_llm_common", _path)
sys.modules["tests_llm_common"] = _module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
