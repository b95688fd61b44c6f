import os
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]
SF = "/root/testdata/sf0.001"  # for tests beside this folder that import it from conftest, when this file goes by that name
