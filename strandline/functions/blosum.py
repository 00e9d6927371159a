"""The BLOSUM substitution matrices (Henikoff and Henikoff), as published."""

# Fixed values. Lower triangle of each symmetric matrix, residues in alphabetical order. They are counts from aligned
# protein blocks, rounded when published, so no rule gives them back.
TRIANGLES = {
    "blosum45": """
A 5
B -1 4
C -1 -2 12
D -2 5 -3 7
E -1 1 -3 2 6
F -2 -3 -2 -4 -3 8
G 0 -1 -3 -1 -2 -3 7
H -2 0 -3 0 0 -2 -2 10
I -1 -3 -3 -4 -3 0 -4 -3 5
K -1 0 -3 0 1 -3 -2 -1 -3 5
L -1 -3 -2 -3 -2 1 -3 -2 2 -3 5
M -1 -2 -2 -3 -2 0 -2 0 2 -1 2 6
N -1 4 -2 2 0 -2 0 1 -2 0 -3 -2 6
P -1 -2 -4 -1 0 -3 -2 -2 -2 -1 -3 -2 -2 9
Q -1 0 -3 0 2 -4 -2 1 -2 1 -2 0 0 -1 6
R -2 -1 -3 -1 0 -2 -2 0 -3 3 -2 -1 0 -2 1 7
S 1 0 -1 0 0 -2 0 -1 -2 -1 -3 -2 1 -1 0 -1 4
T 0 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 2 5
V 0 -3 -1 -3 -3 0 -3 -3 3 -2 1 1 -3 -3 -3 -2 -1 0 5
W -2 -4 -5 -4 -3 1 -2 -3 -2 -2 -2 -2 -4 -3 -2 -2 -4 -3 -3 15
X 0 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 0 0 -1 -2 -1
Y -2 -2 -3 -2 -2 3 -3 2 0 -1 0 0 -2 -3 -1 -1 -2 -1 -1 3 -1 8
Z -1 2 -3 1 4 -3 -2 0 -3 1 -2 -1 0 -1 4 0 0 -1 -3 -2 -1 -2 4
""",
    "blosum50": """
A 5
B -2 5
C -1 -3 13
D -2 5 -4 8
E -1 1 -3 2 6
F -3 -4 -2 -5 -3 8
G 0 -1 -3 -1 -3 -4 8
H -2 0 -3 -1 0 -1 -2 10
I -1 -4 -2 -4 -4 0 -4 -4 5
K -1 0 -3 -1 1 -4 -2 0 -3 6
L -2 -4 -2 -4 -3 1 -4 -3 2 -3 5
M -1 -3 -2 -4 -2 0 -3 -1 2 -2 3 7
N -1 4 -2 2 0 -4 0 1 -3 0 -4 -2 7
P -1 -2 -4 -1 -1 -4 -2 -2 -3 -1 -4 -3 -2 10
Q -1 0 -3 0 2 -4 -2 1 -3 2 -2 0 0 -1 7
R -2 -1 -4 -2 0 -3 -3 0 -4 3 -3 -2 -1 -3 1 7
S 1 0 -1 0 -1 -3 0 -1 -3 0 -3 -2 1 -1 0 -1 5
T 0 0 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 2 5
V 0 -4 -1 -4 -3 -1 -4 -4 4 -3 1 1 -3 -3 -3 -3 -2 0 5
W -3 -5 -5 -5 -3 1 -3 -3 -3 -3 -2 -1 -4 -4 -1 -3 -4 -3 -3 15
X -1 -1 -2 -1 -1 -2 -2 -1 -1 -1 -1 -1 -1 -2 -1 -1 -1 0 -1 -3 -1
Y -2 -3 -3 -3 -2 4 -3 2 -1 -2 -1 0 -2 -3 -1 -1 -2 -2 -1 2 -1 8
Z -1 2 -3 1 5 -4 -2 0 -3 1 -3 -1 0 -1 4 0 0 -1 -3 -2 -1 -2 5
""",
    "blosum62": """
A 4
B -2 4
C 0 -3 9
D -2 4 -3 6
E -1 1 -4 2 5
F -2 -3 -2 -3 -3 6
G 0 -1 -3 -1 -2 -3 6
H -2 0 -3 -1 0 -1 -2 8
I -1 -3 -1 -3 -3 0 -4 -3 4
K -1 0 -3 -1 1 -3 -2 -1 -3 5
L -1 -4 -1 -4 -3 0 -4 -3 2 -2 4
M -1 -3 -1 -3 -2 0 -3 -2 1 -1 2 5
N -2 3 -3 1 0 -3 0 1 -3 0 -3 -2 6
P -1 -2 -3 -1 -1 -4 -2 -2 -3 -1 -3 -2 -2 7
Q -1 0 -3 0 2 -3 -2 0 -3 1 -2 0 0 -1 5
R -1 -1 -3 -2 0 -3 -2 0 -3 2 -2 -1 0 -2 1 5
S 1 0 -1 0 0 -2 0 -1 -2 0 -2 -1 1 -1 0 -1 4
T 0 -1 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1 0 -1 -1 -1 1 5
V 0 -3 -1 -3 -2 -1 -3 -3 3 -2 1 1 -3 -2 -2 -3 -2 0 4
W -3 -4 -2 -4 -3 1 -2 -2 -3 -3 -2 -1 -4 -4 -2 -3 -3 -2 -3 11
X 0 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 -1 -1 0 0 -1 -2 -1
Y -2 -3 -2 -3 -2 3 -3 2 -1 -2 -1 -1 -2 -3 -1 -2 -2 -2 -1 2 -1 7
Z -1 1 -3 1 4 -3 -2 0 -3 1 -3 -1 0 -1 3 0 0 -1 -2 -3 -1 -2 4
""",
    "blosum80": """
A 7
B -3 6
C -1 -6 13
D -3 6 -7 10
E -2 1 -7 2 8
F -4 -6 -4 -6 -6 10
G 0 -2 -6 -3 -4 -6 9
H -3 -1 -7 -2 0 -2 -4 12
I -3 -6 -2 -7 -6 -1 -7 -6 7
K -1 -1 -6 -2 1 -5 -3 -1 -5 8
L -3 -7 -3 -7 -6 0 -7 -5 2 -4 6
M -2 -5 -3 -6 -4 0 -5 -4 2 -3 3 9
N -3 5 -5 2 -1 -6 -1 1 -6 0 -6 -4 9
P -1 -4 -6 -3 -2 -6 -5 -4 -5 -2 -5 -4 -4 12
Q -2 -1 -5 -1 3 -5 -4 1 -5 2 -4 -1 0 -3 9
R -3 -2 -6 -3 -1 -5 -4 0 -5 3 -4 -3 -1 -3 1 9
S 2 0 -2 -1 -1 -4 -1 -2 -4 -1 -4 -3 1 -2 -1 -2 7
T 0 -1 -2 -2 -2 -4 -3 -3 -2 -1 -3 -1 0 -3 -1 -2 2 8
V -1 -6 -2 -6 -4 -2 -6 -5 4 -4 1 1 -5 -4 -4 -4 -3 0 7
W -5 -8 -5 -8 -6 0 -6 -4 -5 -6 -4 -3 -7 -7 -4 -5 -6 -5 -5 16
X -1 -3 -4 -3 -2 -3 -3 -2 -2 -2 -2 -2 -2 -3 -2 -2 -1 -1 -2 -5 -2
Y -4 -5 -5 -6 -5 4 -6 3 -3 -4 -2 -3 -4 -6 -3 -4 -3 -3 -3 3 -3 11
Z -2 0 -7 1 6 -6 -4 0 -6 1 -5 -3 -1 -2 5 0 -1 -2 -4 -5 -1 -4 6
""",
    "blosum90": """
A 5
B -2 4
C -1 -4 9
D -3 4 -5 7
E -1 0 -6 1 6
F -3 -4 -3 -5 -5 7
G 0 -2 -4 -2 -3 -5 6
H -2 -1 -5 -2 -1 -2 -3 8
I -2 -5 -2 -5 -4 -1 -5 -4 5
K -1 -1 -4 -1 0 -4 -2 -1 -4 6
L -2 -5 -2 -5 -4 0 -5 -4 1 -3 5
M -2 -4 -2 -4 -3 -1 -4 -3 1 -2 2 7
N -2 4 -4 1 -1 -4 -1 0 -4 0 -4 -3 7
P -1 -3 -4 -3 -2 -4 -3 -3 -4 -2 -4 -3 -3 8
Q -1 -1 -4 -1 2 -4 -3 1 -4 1 -3 0 0 -2 7
R -2 -2 -5 -3 -1 -4 -3 0 -4 2 -3 -2 -1 -3 1 6
S 1 0 -2 -1 -1 -3 -1 -2 -3 -1 -3 -2 0 -2 -1 -1 5
T 0 -1 -2 -2 -1 -3 -3 -2 -1 -1 -2 -1 0 -2 -1 -2 1 6
V -1 -4 -2 -5 -3 -2 -5 -4 3 -3 0 0 -4 -3 -3 -3 -2 -1 5
W -4 -6 -4 -6 -5 0 -4 -3 -4 -5 -3 -2 -5 -5 -3 -4 -4 -4 -3 11
X -1 -2 -3 -2 -2 -2 -2 -2 -2 -1 -2 -1 -2 -2 -1 -2 -1 -1 -2 -3 -2
Y -3 -4 -4 -4 -4 3 -5 1 -2 -3 -2 -2 -3 -4 -3 -3 -3 -2 -3 2 -2 8
Z -1 0 -5 0 4 -4 -3 0 -4 1 -4 -2 -1 -2 4 0 -1 -1 -3 -4 -1 -3 4
""",
}
